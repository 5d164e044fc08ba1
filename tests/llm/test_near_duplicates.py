"""SimHash near duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from alertflow.llm import simhash
from alertflow.llm.components import components
from alertflow.llm.simhash import drop_near_duplicates, fingerprint, shard_links, simhash_groups
from llm_frames import edge_docs


def _fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = len(words)
    shingles = [" ".join(words[i:i + 3]) for i in range(n - 2)] if n >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _labels(nodes, links):
    """Smallest node reachable, by union-find."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _brute_links(fps, distance):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if bin(a ^ b).count("1") <= distance]


def test_fingerprint_matches_the_rule():
    r = random.Random(4)
    texts = [None, "", " \n", "one", "Two WORDS", "a\x0bb\x1cc d e", "É é É é x y"]
    texts += [" ".join(r.choice("ab cd ef g É".split()) for _ in range(r.randrange(1, 200))) for _ in range(60)]
    for t in texts:
        assert fingerprint(None if t is None else t.encode()) == _fingerprint(t)


@pytest.mark.parametrize("ball", [False, True])
def test_shard_links_keep_every_component(ball, monkeypatch):
    """Random words and a dense ball (where bounds cannot prune), in small blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 256)
    monkeypatch.setattr(simhash, "PROBE_KEYS", 4096)
    r = random.Random(8)
    if ball:
        fps = {r.getrandbits(64) & 0 | sum(1 << b for b in r.sample(range(64), r.randrange(0, 4))) for _ in range(500)}
    else:
        fps = {r.getrandbits(64) for _ in range(200)}
        fps |= {f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in list(fps)[:80]}
    fps = sorted(fps)
    a, b = shard_links(np.array(fps, "<u8"), np.empty(0, "<u8"), 2)
    got = _labels(fps, zip(a.tolist(), b.tolist()))
    assert all(bin(x ^ y).count("1") <= 2 for x, y in zip(a.tolist(), b.tolist())) or ball
    assert got == _labels(fps, _brute_links(fps, 2))
    assert len(a) < len(fps)  # a forest, not all pairs


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    links += [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(70)]
    r.shuffle(links)
    got = {x["node"]: x["root"] for x in components(
        spark, spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {n for x in links for n in x}
    want = {n: low for n, low in _labels(nodes, links).items()}
    for n, low in want.items():
        assert got.get(n, n) == low


def _texts():
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(3, 400))) for _ in range(120)]
    texts = list(base)
    for t in base[:40]:
        w = t.split()
        for _ in range(r.randrange(0, 6)):
            v = list(w)
            v[r.randrange(len(v))] = r.choice(words)
            texts.append(" ".join(v))
    return texts + base[:10] * 5 + [None, "", "  "]


@pytest.mark.parametrize("distance, shard_rows", [(2, 16), (2, 4096), (6, 16)])
def test_groups_equal_brute_force(spark, distance, shard_rows):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = simhash_groups(spark, docs, distance=distance, shard_rows=shard_rows).collect()
    fps = {i: _fingerprint(t) for i, t in enumerate(texts)}
    labels = _labels(sorted(set(fps.values())), _brute_links(sorted(set(fps.values())), distance))
    low = {}
    for i, f in fps.items():
        low[labels[f]] = min(low.get(labels[f], i), i)
    assert len(rows) == len(texts)
    for x in rows:
        assert x["fp"] % 2**64 == fps[x["doc_id"]]
        assert x["component_id"] == low[labels[fps[x["doc_id"]]]]


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = simhash_groups(spark, docs).collect()
    assert len(rows) == docs.count()
    kept = drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert len(ids) == len(set(ids)) and 7 in ids  # one row of the repeated ones
    assert simhash_groups(spark, docs.where("false")).count() == 0
    assert drop_near_duplicates(spark, docs.where("false")).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    groups = {x["component_id"] for x in simhash_groups(spark, docs).collect()}
    assert {x["doc_id"] for x in drop_near_duplicates(spark, docs).collect()} == groups
