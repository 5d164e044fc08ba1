"""Spelling variants, mixtures, whitening: brute force, SQL twins, exact arithmetic."""

import random
import re
import zlib
from fractions import Fraction
from itertools import product

import duckdb
import numpy as np
import pytest

from alertflow.llm import mixture, spelling, whitening
from alertflow.llm.mixture import mix_sources, mixed_texts, route, targets
from alertflow.llm.oracle import ORACLE
from alertflow.llm.queries import QUERIES
from alertflow.llm.spelling import spelling_groups, spelling_variants
from alertflow.llm.whitening import whiten
from llm_frames import edge_docs
from oracle_compare import compare, duck

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op12_mixture", "op13_spelling"])
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF001), duck(SF001), ORACLE[name]) > 0


# --- spelling ----------------------------------------------------------------

def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _spelling(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if _near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= 2 * n else None, n, len(near))
    rows = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, near, counts[form] if form else None))
    return sorted(rows)


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnop"])
def test_spelling_groups_equal_brute_force(spark, letters):
    rng = random.Random(letters)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(150)}
    for w in list(words)[:80]:  # neighbours of some, also at both ends
        i = rng.randrange(len(w) + 1)
        words.add(w[:i] + rng.choice(letters) + w[i:])
        words.add(w[:i] + rng.choice(letters) + w[i + 1:])
    counts = {w: rng.choice([3, 3, 4, 6, 12, 30, 100]) for w in words if len(w) >= 5}
    got = spelling_groups(spark, spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == _spelling(counts)


def test_pivots_are_the_rarest_disjoint_pair():
    rng = random.Random(3)
    order = {"".join(p): k for k, p in enumerate(rng.sample(list(product("abcd", repeat=2)), 16))}
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 12)))
        _, places = spelling.prefix(word, order)
        got = spelling.pivots(word, places, order)
        pairs = [(a, b) for a in places for b in places if b >= a + 2]
        cost = lambda ps: sum(order[word[p:p + 2]] for p in ps)
        assert tuple(got) in pairs and cost(got) == min(map(cost, pairs))


def test_words_and_typos_follow_the_rule(spark):
    texts = ["Émile ÉMILE Ärger straße don't x×yzab WORDS words Words\nwords", None, "", "abcde " * 50,
             "naïve façade naïve façade naïve 日本語 façade"]
    rows = [(i, t) for i, t in enumerate(texts * 40)] + [(None, "words " * 9), (None, "words " * 9)]
    counts = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            w = run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run
            counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling_variants(spark, docs, typo_every=97)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == _spelling(counts)
    assert counts["words"] > 18


def test_spelling_edges(spark):
    got = {r["word"]: r for r in spelling_variants(spark, edge_docs(spark)).collect()}
    assert got["words"]["n"] == 8000 and got["words"]["root"] == "words"
    assert spelling_variants(spark, edge_docs(spark).limit(0)).collect() == []


def test_chain_of_forms_ends_at_the_root(spark):
    names = ["aaaaaaaa"[:k] + "bbbbbbbb"[k:] for k in range(9)]  # each one letter from the next
    rows = [(w, 3 * 2 ** k) for k, w in enumerate(names)]
    got = {r["word"]: (r["form"], r["root"]) for r in
           spelling_groups(spark, spark.createDataFrame(rows, "word string, n long")).collect()}
    want = _spelling(dict(rows))
    assert got == {r[0]: (r[1], r[2]) for r in want}
    assert sum(root == names[-1] for _, root in got.values()) > 4


# --- mixture -----------------------------------------------------------------

def test_targets_stop_at_three_times_the_size():
    got = targets([10, 100, 1000, 0], [5, 2, 1, 5], 1110)
    assert got[0] == 30 and got[1] == 300 and got[3] == 0
    assert sum(got) == 1110 and got[2] == 780
    assert targets([], [], 0) == [] and targets([0, 0], [5, 2], 0) == [0, 0]
    assert targets([100, 100, 100], [5, 2, 1], 300) == [Fraction(375, 2), 75, Fraction(75, 2)]


def _cheapest(patterns, quotas, repeats):
    """Most words, then least cost, over all routings (tiny cases)."""
    best = (0, 0)
    ways = []
    for members, words in patterns:
        room = range(repeats * words + 1)
        ways.append([w for w in product(room, repeat=len(members)) if sum(w) <= repeats * words])
    for choice in product(*ways):
        filled = [0] * len(quotas)
        for (members, _), w in zip(patterns, choice):
            for s, x in zip(members, w):
                filled[s] += x
        if all(f <= q for f, q in zip(filled, quotas)):
            cost = sum(max(0, sum(w) - k * n) for (_, n), w in zip(patterns, choice) for k in range(1, repeats))
            best = max(best, (sum(filled), -cost))
    return best


def test_flow_is_the_cheapest_full_one():
    rng = random.Random(5)
    for _ in range(25):
        n = rng.randrange(1, 4)
        patterns = [(sorted(rng.sample(range(n), rng.randrange(1, min(n, 2) + 1))), rng.randrange(0, 3))
                    for _ in range(rng.randrange(1, 4))]
        quotas = [rng.randrange(0, 6) for _ in range(n)]
        gives = route(patterns, quotas, 2)
        filled = [sum(g.get(s, 0) for g in gives) for s in range(n)]
        given = [sum(g.values()) for g in gives]
        assert all(f <= q for f, q in zip(filled, quotas))
        assert all(set(g) <= set(m) and t <= 2 * w for g, (m, w), t in zip(gives, patterns, given))
        cost = sum(max(0, t - w) for t, (_, w) in zip(given, patterns))
        assert (sum(given), -cost) == _cheapest(patterns, quotas, 2)


def test_overlapping_sources_share_their_documents(spark):
    rows = [(i, "w " * (1 + i % 7), ["a"] if i % 3 else ["a", "b"]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lists array<string>").repartition(4)
    mixed, sources = mix_sources(spark, docs, members=docs["lists"], weights=(1, 1))
    plan = {r["source"]: r for r in sources.collect()}
    total = sum(1 + i % 7 for i in range(300))
    shared = sum(1 + i % 7 for i in range(0, 300, 3))
    assert plan["a"]["source_size"] == total and plan["b"]["source_size"] == shared
    assert plan["b"]["target"] == total / 2 and plan["b"]["taken"] == total // 2
    assert plan["a"]["taken"] == total // 2
    got = mixed.collect()
    assert len(got) == 300 and sum(r["mix_taken"] for r in got) == 2 * (total // 2)
    by = {}
    for r in got:
        by[r["mix_pattern"]] = by.get(r["mix_pattern"], 0) + r["mix_taken"]
    # b has only shared documents, so a takes its own ones first
    assert by['["a","b"]'] == total // 2 and by['["a"]'] == total // 2


def _mix(rows, quotas):
    """Brute force: the seeded order of a source, one document after the other."""
    out = []
    for source, quota in quotas.items():
        mine = sorted((r for r in rows if r[0] == source), key=lambda r: r[1:3])
        words = sum(r[2] for r in mine)
        q, rest = divmod(quota, words) if words else (0, 0)
        for r in mine:
            more = min(r[2], rest)
            rest -= more
            out.append((source, r[2], q * r[2] + more))
    return sorted(out, key=str)


@pytest.mark.parametrize("digit", [12, 3])
def test_selection_equals_brute_force(spark, monkeypatch, digit):
    monkeypatch.setattr(mixture, "DIGIT", digit)
    rng = random.Random(digit)
    docs = [(i if i % 11 else None, "w\t" * rng.choice([0, 1, 2, 30, 400]), rng.choice(["a", "b", "c", None, "null"]))
            for i in range(400)]
    docs += [(7, "same words here", "a")] * 150     # repeated rows
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    mixed, sources = mix_sources(spark, frame, keep=("doc_id", "source"))
    plan = {r["source"]: r for r in sources.collect()}
    assert list(plan) == ["a", "b", "c", "null", None]
    got = mixed.collect()
    from hashlib import md5
    place = lambda i, t: md5(f"42:{f'id:{i}' if i is not None else f'text:{t}'}".encode()).hexdigest()[:15]
    rows = [(s, place(i, t), len(t.split())) for i, t, s in docs]
    assert sorted(((r["source"], r["mix_size"], r["mix_taken"]) for r in got), key=str) == _mix(
        rows, {s: r["quota"] for s, r in plan.items()})
    assert all(r["taken"] == r["quota"] for r in plan.values())
    again = mix_sources(spark, frame.repartition(2), keep=("doc_id", "source"))[0].collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mixture_edges(spark):
    mixed, sources = mix_sources(spark, edge_docs(spark), keep=("doc_id", "text", "TOXICITY_SCORE"))
    rows = mixed.collect()
    assert len(rows) == edge_docs(spark).count() and all(0 <= r["mix_taken"] <= 3 * r["mix_size"] for r in rows)
    assert sum(r["mix_taken"] for r in rows) == sum(r["taken"] for r in sources.collect())
    words = mixed_texts(mixed).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in words) == sum(r["mix_taken"] for r in rows)
    mixed, sources = mix_sources(spark, edge_docs(spark).limit(0))
    assert mixed.collect() == [] and sources.collect() == []


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixture, "MAX_PATTERNS", 1)
    with pytest.raises(ValueError):
        mix_sources(spark, edge_docs(spark))


# --- whitening ---------------------------------------------------------------

def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component string").repartition(3)


def _characteristic(m):
    """Faddeev-LeVerrier in exact fractions."""
    d = len(m)
    out, part = [1], np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        part = m @ part
        c = -sum(part[i, i] for i in range(d)) / k
        out.append(c)
        part = part + np.array([[c * int(i == j) for j in range(d)] for i in range(d)], object)
    return [int(c) for c in out]


@pytest.mark.parametrize("dim,rank", [(1, 1), (2, 2), (5, 5), (9, 4), (8, 8)])
def test_polynomial_is_exact(spark, dim, rank):
    rng = random.Random(dim)
    a = np.array([[rng.randrange(-10 ** 6, 10 ** 6) for _ in range(dim)] for _ in range(rank)], object)
    m = a.T @ a
    assert whitening.characteristic_polynomial(spark, m) == _characteristic(m)


def test_gram_matrix_is_exact_for_any_long():
    rng = random.Random(1)
    for top in (300, 1 << 21, 1 << 40, (1 << 63) - 1):
        x = np.array([[rng.randrange(-top - 1, top + 1) for _ in range(3)] for _ in range(50)], "i8")
        want = x.astype(object).T @ x.astype(object)
        assert (whitening.gram_matrix(x) == want).all()


def test_close_and_equal_roots_are_told_apart():
    poly = lambda roots: [int(c) for c in _poly(roots)]
    got = whitening.largest_roots(poly([10 ** 15, 10 ** 15 - 1, 7, 7, 3, 0]), 4)
    assert [m for *_, m in got] == [1, 1, 2] and [round(Fraction(a, 1 << b)) for a, b, _ in got] == [10 ** 15, 10 ** 15 - 1, 7]
    assert whitening.largest_roots(poly([0, 0]), 4) == []
    assert [m for *_, m in whitening.largest_roots(poly([5, 5, 5]), 2)] == [3]


def _poly(roots):
    out = [1]
    for r in roots:
        out = [a - r * b for a, b in zip(out + [0], [0] + out)]
    return out


@pytest.mark.parametrize("dim,rows", [(6, 300), (3, 40), (12, 8)])
def test_whitening_equals_plain_eigenvectors(spark, dim, rows):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(rows, dim)) * np.linspace(0.3, 2, dim) + rng.normal(size=dim)
    x = np.concatenate([x, x[:5], x[:1]])           # repeated vectors count once
    frame = _vectors(spark, [(i, v.tolist(), "n", "c") for i, v in enumerate(x)])
    got = whiten(spark, frame).toPandas()
    q = np.floor(x * 256).astype("i8")
    fit = np.unique(q, axis=0)
    n, s = len(fit), fit.sum(0)
    w, v = np.linalg.eigh(np.cov(fit.T.astype("f8"), bias=True))
    rank = min(4, dim, n - 1)
    assert sorted(got["component"].unique()) == list(range(1, rank + 1)) and len(got) == rank * len(x)
    for k in range(rank):
        part = got[got["component"] == k + 1].set_index("vec_id").loc[range(len(x))]
        want = (q - s / n) @ v[:, -1 - k] / w[-1 - k] ** 0.5
        assert min(abs(part["whitened"] - want).max(), abs(part["whitened"] + want).max()) < 1e-8
        assert abs(part["explained"] - w[-1 - k] / w.sum()).max() < 1e-12
        assert (part["deviation"].to_numpy() == ((n * q - s) ** 2).sum(1)).all() and (part["n"] == n).all()
    assert got["identity_error"].max() < 1e-12 and got["identity_error"].nunique() == 1


def test_equal_eigenvalues_give_an_orthonormal_basis(spark):
    corners = [(1.0, 1.0, 1.0), (-1.0, 1.0, 1.0), (1.0, -1.0, 1.0), (1.0, 1.0, -1.0),
               (-1.0, -1.0, 1.0), (-1.0, 1.0, -1.0), (1.0, -1.0, -1.0), (-1.0, -1.0, -1.0)]
    got = whiten(spark, _vectors(spark, [(i, list(c), "n", "c") for i, c in enumerate(corners)])).toPandas()
    y = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(y.T @ y / 8 - np.eye(3)).max() < 1e-12 and np.allclose(got["explained"], 1 / 3)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.25]), (2, [0.25, 1.0]), (None, [0.125, 0.0]), (4, [0.0, 0.0]), (4, [0.0, 0.0])]
    bad = [(5, None), (6, [1.0, nan]), (7, [inf, 1.0]), (8, [1.0, None]), (9, []), (10, [1.0, 2.0, 3.0])]
    got = whiten(spark, _vectors(spark, [(i, v, "n", "c") for i, v in good + bad])).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted(
        [(i, k) for i in (1, 2, 0, 4, 4) for k in (1, 2)]) and {r["n"] for r in got} == {4}
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        assert whiten(spark, _vectors(spark, [(i, v, "n", "c") for i, v in rows])).collect() == []
    # beyond a long: the digits are there; entries beyond 64 bits stop at their end
    far = whiten(spark, _vectors(spark, [(1, [1e14], "", ""), (2, [-1e14], "", ""), (3, [1e300], "", "")])).collect()
    top = (1 << 63) - 1
    x = [256 * 10 ** 14, -256 * 10 ** 14, top]
    assert {r["vec_id"]: int(r["deviation_text"]) for r in far} == {
        i + 1: (3 * v - sum(x)) ** 2 for i, v in enumerate(x)} and all(r["deviation"] is None for r in far)


def test_embeddings_query_reads_every_row(spark):
    got = QUERIES["op11_whitening"](spark, SF001)
    n = duckdb.sql(f"SELECT count(*) FROM '{SF001}/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall()[0][0]
    assert got.count() == 4 * n
