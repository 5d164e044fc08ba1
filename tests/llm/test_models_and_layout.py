"""Neighbours, toxicity, sharding, packing: brute force, held-out accuracy, round trips."""

import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from alertflow.llm import neighbours, packing, toxicity
from alertflow.llm.interleave import interleave, write_shards
from alertflow.llm.neighbours import balanced_parts, nearest_neighbours
from alertflow.llm.packing import Encoder, pack, plan_slots, tokenizer_path
from alertflow.llm.queries import QUERIES
from llm_frames import edge_docs

SF01 = "/root/testdata/sf0.01"


# --- neighbours --------------------------------------------------------------

def _recall(got, ids, x, k, every):
    hits = total = 0
    for q in (i for i in ids if i % every == 0):
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        order = [i for i in sorted(range(len(ids)), key=lambda i: (d[i], ids[i])) if ids[i] != q][:k]
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(order) + 1))
        assert [(r["score"], r["vec_id"]) for r in rows] == sorted((r["score"], r["vec_id"]) for r in rows)
        for r in rows:
            assert r["vec_id"] != q and r["score"] == pytest.approx(d[ids.index(r["vec_id"])], abs=1e-12)
        hits += len({r["vec_id"] for r in rows} & {ids[i] for i in order})
        total += len(order)
    return hits / total


def test_recall_against_brute_force(spark):
    """Clusters, blocks smaller than a part, and a vector that a third of all rows share."""
    r = np.random.default_rng(5)
    centers = r.normal(size=(40, 16))
    x = centers[r.integers(0, 40, 3000)] + 0.4 * r.normal(size=(3000, 16))
    x[::3] = x[0]
    ids = list(range(3000))
    df = spark.createDataFrame([(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)],
                               "vec_id long, embedding array<float>").repartition(4)
    got = nearest_neighbours(spark, df, query_every=50, block_rows=200).collect()
    assert _recall(got, ids, x.astype("f4").astype("f8"), 10, 50) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_search_reaches_the_recall(spark, monkeypatch, sf):
    """The given tables have more than one part, so graph and classifier decide."""
    fitted = []
    monkeypatch.setattr(neighbours, "fit_router", lambda *a, f=neighbours.fit_router: fitted.append(f(*a)) or fitted[-1])
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '/root/testdata/{sf}/embeddings.parquet' ORDER BY 1").df()
    x = np.stack(rows["embedding"]).astype("f8")
    got = QUERIES["op2_neighbours"](spark, f"/root/testdata/{sf}").collect()
    assert _recall(got, rows["vec_id"].tolist(), x, 10, 100) >= 0.9
    assert fitted[0].w2.shape[1] == {"sf0.01": 2, "sf0.1": 4}[sf]
    print(sf, "parts", fitted[0].w2.shape[1], "probes", fitted[0].probes)


def test_parts_grow_with_the_rows():
    sizes = [neighbours.number_of_parts(n) for n in (0, 100, 200, 2000, 51_282, 10 ** 8, 10 ** 12)]
    assert sizes == [1, 1, 2, 4, 32, 1024, 4096]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [1.0, None]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (2, [1.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest_neighbours(spark, df).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0.0), (0, 2, 2, 0.0), (0, 3, 1, 2 ** 0.5)]
    # a query whose id repeats: the other row is a candidate, and asks as well
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, nearest_neighbours(spark, twice).collect())) == [
        (0, 1, 1, 1.0), (0, 1, 1, 1.0), (0, 2, 0, 2.0), (0, 2, 0, 2.0)]
    assert nearest_neighbours(spark, df.where("false")).count() == 0
    assert nearest_neighbours(spark, df.where("vec_id = 0")).count() == 0


def test_parts_are_balanced():
    graph = np.random.default_rng(0).integers(0, 999, (999, 10))
    sizes = np.bincount(balanced_parts(graph, 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2


# --- toxicity ------------------------------------------------------------------

def test_learns_a_pair_that_single_terms_do_not_show():
    """Toxic only when the insult meets the group; each alone is as often clean."""
    r = random.Random(7)
    rows, marks = [], []
    for _ in range(3000):
        words = {f"w{r.randrange(300)}" for _ in range(20)}
        a, b = r.random() < 0.5, r.random() < 0.5
        words |= ({"insultt"} if a else set()) | ({"groupp"} if b else set())
        rows.append(toxicity.terms(" ".join(sorted(words))))
        marks.append(int(a == b))
    machine = toxicity.fit(rows[:2500], np.array(marks[:2500]), epochs=1)
    # the marginals are even, so the terms have to be let in to see the pair
    keep, toxicity.MIN_Z = toxicity.MIN_Z, 0.0
    try:
        machine = toxicity.fit(rows[:2500], np.array(marks[:2500]), epochs=30)
    finally:
        toxicity.MIN_Z = keep
    right = ((machine.score(rows[2500:]) >= 0.5) == np.array(marks[2500:])).mean()
    linear = toxicity.Machine(machine.bias, machine.weight, np.zeros_like(machine.factor))
    assert right > 0.8 > ((linear.score(rows[2500:]) >= 0.5) == np.array(marks[2500:])).mean()


def test_learns_a_pair_with_the_production_bounds():
    """As above, but with the bounds, epochs and rate of the query."""
    r = random.Random(8)
    rows, marks = [], []
    for _ in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = {f"w{r.randrange(300)}" for _ in range(20)} | ({"insultt"} if a else set()) | ({"groupp"} if b else set())
        rows.append(toxicity.terms(" ".join(sorted(words))))
        marks.append(int(a == b))
    assert toxicity.MIN_Z == 3.0
    machine = toxicity.fit(rows[:2500], np.array(marks[:2500]))
    assert ((machine.score(rows[2500:]) >= 0.5) == np.array(marks[2500:])).mean() > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op10_toxicity"](spark, sf)
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = scored.where("held_out").join(marks, "doc_id").collect()
    toxic = [x for x in rows if x["toxic"] == 1]
    caught = sum(x["predicted"] for x in toxic)
    wrong = sum(x["predicted"] for x in rows if x["toxic"] == 0)
    assert len(toxic) > 50 and caught >= 0.85 * len(toxic) and wrong <= 0.02 * len(rows)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in rows)
    assert scored.where("held_out").count() == sum(
        zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 for x in scored.collect())


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """Rows of one id, with one text or with many, do not outgrow the sample."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    each = [(i, f"text {i}") for i in ids]
    sizes = []
    for more in ([(ids[0], "same")] * 2000, [(ids[0], f"other {k}") for k in range(5000)]):
        docs = spark.createDataFrame(each + more, "doc_id long, text string")
        sizes.append(toxicity.training_rows(spark, docs, labels, rows=1000).count())
    assert sizes[0] == len(ids) + 1 and 700 < sizes[1] <= 1000
    # the terms are bounded as well: here about 7 a row
    monkeypatch.setattr(toxicity, "TRAIN_TERMS", 2000)
    few = toxicity.training_rows(spark, docs, labels, rows=1000).collect()
    assert 100 < len(few) < sizes[1] and sum(len(r["terms"]) for r in few) <= 2000


def test_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    machine = toxicity.Machine(0.3, rng.normal(size=1 << toxicity.BITS), rng.normal(size=(1 << toxicity.BITS, 4)))
    machine.factor[::3] = 0
    rows = [np.sort(rng.choice(1 << toxicity.BITS, n, replace=False)).astype("i4") for n in (0, 1, 2, 9, 40)]
    for got, row in zip(machine.raw(rows), rows):
        some = max(sum(bool(machine.factor[i].any()) for i in row), 1)
        pairs = sum(machine.factor[i] @ machine.factor[j] for a, i in enumerate(row) for j in row[a + 1:])
        assert abs(got - (machine.bias + machine.weight[row].sum() + pairs / some)) < 1e-4


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8)] + [(None, 1, 1), (3, 0, None)],
                                   "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(spark, docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= x["score"] <= 1 for x in rows)
    assert len({x["score"] for x in rows if x["doc_id"] in (0, 1, 2)}) == 1  # texts without terms
    kept = toxicity.drop_toxic(spark, docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() in (0, docs.count())
    assert toxicity.score_toxicity(spark, docs.where("false"), labels).count() == 0


# --- sharding ------------------------------------------------------------------

def test_shards_match_the_mixture(spark, tmpdir_work):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    placed = interleave(spark, docs, 24, bucket_rows=64)
    rows = placed.collect()
    sizes = np.bincount([x["shard"] for x in rows], minlength=24)
    assert len(rows) == docs.count() and sizes.max() - sizes.min() <= 1
    for shard in range(24):
        assert sorted(x["slot"] for x in rows if x["shard"] == shard) == list(range(sizes[shard]))
    for source in {x["source"] for x in rows}:
        n = sum(x["source"] == source for x in rows)
        per = np.bincount([x["shard"] for x in rows if x["source"] == source], minlength=24)
        assert abs(per - n / 24).max() <= 2
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    for x in rows:
        raw = (texts[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    key = lambda x: (x["doc_id"], x["shard"], x["slot"])
    assert sorted(map(key, interleave(spark, docs, 24).collect())) == sorted(map(key, rows))
    write_shards(placed, docs, f"{tmpdir_work}/shards")
    assert spark.read.parquet(f"{tmpdir_work}/shards").groupBy("shard").count().count() == 24


def test_shards_equal_brute_force(spark):
    """Rank by seeded key inside each source, order by fractional rank, cut evenly; a
    source with half of the rows, one of one row, a null source, repeated rows."""
    from pyspark.sql import functions as F
    r = random.Random(9)
    rows = [(i, "é" * r.randint(0, 30) if i % 9 else None, r.choice(["a", "a", "a", "b", "ü", None])) for i in range(700)]
    rows += [rows[3]] * 4 + [(9_000, "alone", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    keyed = docs.select("doc_id", "text", "source", F.xxhash64(
        F.lit(42), "doc_id", F.crc32(raw), (F.octet_length(raw) + 8).cast("long")).alias("key")).collect()
    by_source = {}
    for x in keyed:
        text = (x["text"] or "").encode()
        source = b"" if x["source"] is None else b"=" + x["source"].encode()
        by_source.setdefault(source, []).append(
            (x["key"] & (2**63 - 1), x["doc_id"], x["source"], len(text) + 8, zlib.crc32(text)))
    placed = sorted(((2 * k - 1) / (2.0 * len(group)), source, row) for source, group in by_source.items()
                    for k, row in enumerate(sorted(group, key=lambda g: g[:2]), 1))
    want, filled = [], [0] * 24
    for at, (_, _, (_, doc_id, source, size, crc)) in enumerate(placed):
        shard = at * 24 // len(placed)
        want.append((doc_id, source or "", size, crc, shard, filled[shard]))
        filled[shard] += 1
    for bucket_rows in (16, 4_096):  # many buckets, and one
        got = interleave(spark, docs, 24, bucket_rows=bucket_rows).collect()
        assert sorted((x["doc_id"], x["source"] or "", x["size"], x["text_crc32"], x["shard"], x["slot"])
                      for x in got) == sorted(want)


def test_sharding_edges(spark):
    docs = edge_docs(spark)
    rows = interleave(spark, docs, 5, bucket_rows=2).collect()
    sizes = np.bincount([x["shard"] for x in rows], minlength=5)
    assert len(rows) == docs.count() and sizes.max() - sizes.min() <= 1
    assert interleave(spark, docs.where("false"), 5).count() == 0
    assert interleave(spark, docs.limit(2), 5).count() == 2


def test_every_row_is_written_once(spark, tmpdir_work):
    """Null ids, repeated rows, one id on a third of the rows; several ordered files a shard."""
    docs = edge_docs(spark)
    rows = [(None if i % 7 == 0 else 5 if i % 3 == 0 else i, f"text {i % 10}" if i % 3 else None, f"s{i % 2}")
            for i in range(600)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for name, df, shards in (("edge", docs, 3), ("many", many, 4)):
        path = f"{tmpdir_work}/{name}"
        write_shards(interleave(spark, df, shards, bucket_rows=16), df, path, file_rows=40)
        got = spark.read.parquet(path)
        key = lambda x: str(tuple(x[c] for c in df.columns))
        assert sorted(map(key, got.collect())) == sorted(map(key, df.collect()))
        n = df.count()
        assert {tuple(x) for x in got.select("shard", "slot").collect()} == {
            tuple(x) for x in interleave(spark, df, shards, bucket_rows=16).select("shard", "slot").collect()}
    for shard in range(4):
        files = sorted(Path(f"{tmpdir_work}/many/shard={shard}").glob("*.parquet"))
        slots = [v for f in files for (v,) in duckdb.sql(f"SELECT slot FROM '{f}'").fetchall()]
        assert len(files) == 4 and slots == list(range(n // 4))
    write_shards(interleave(spark, docs.where("false"), 3), docs.where("false"), f"{tmpdir_work}/none")


# --- packing -------------------------------------------------------------------

def test_encoder_equals_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer
    import pyarrow as pa
    whole = Tokenizer.from_file(tokenizer_path())
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF01}/documents.parquet' LIMIT 300").fetchall()]
    texts += ["", None, " ", "Σίσυφος ΟΔΟΣ", "a<|endoftext|>b", "<|ENDOFTEXT|>", "it's I'LL ''ss", "é́ x", "a\tb\x0bc\x1cd\xa0e",
              "</w> a</w></w>", "İstanbul ŉ Ĳ ſ 12ab3", "日本 😀", "--__--", "ÄÖÜ ŸŽ"]
    for remember in (500_000, 10):
        monkeypatch.setattr(packing, "REMEMBER", remember)
        got = Encoder(tokenizer_path()).encode(pa.array(texts))
        for t, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_plan_fills_every_slot_once():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.choice([8, 50, 2048])
        counts = {n: r.randrange(1, 30) for n in r.sample(range(1, capacity + 1), r.randrange(1, min(capacity, 40)))}
        fill, placed = {}, {n: [] for n in counts}
        for n, a, z, first, offset in plan_slots(counts, capacity):
            placed[n] += range(a, z)
            for k in range(z - a):
                fill.setdefault(first + k, []).append((offset, n))
        assert all(sorted(v) == list(range(counts[n])) for n, v in placed.items())
        for parts in fill.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
        # best-fit decreasing needs at most 11/9 of the fewest sequences, and one more
        least = -(-sum(n * c for n, c in counts.items()) // capacity)
        big = sum(c for n, c in counts.items() if 2 * n > capacity)
        assert len(fill) <= 11 / 9 * max(least, big) + least * 0.12 + 1


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_path())
    docs = edge_docs(spark)
    rows = pack(spark, docs, capacity=64).collect()
    by_doc = {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
    for x in docs.collect():
        if x["doc_id"] in (None, 7):
            continue
        ids = whole.encode(x["text"] or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[x["doc_id"]], key=lambda p: p["piece"])
        assert [p["start"] for p in parts] == list(range(0, len(ids), 64))
        for p in parts:
            part = ids[p["start"]:p["start"] + 64]
            assert p["length"] == len(part)
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    fill = {}
    for x in rows:
        fill.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(fill) <= sum(x["length"] for x in rows) / 64 + 2
    assert len(by_doc[7]) == 2 and len(by_doc[None]) == 2
    assert pack(spark, docs.where("false")).count() == 0
