"""SimHash near-duplicates, found with a vantage-point tree of fingerprints.

1. Each text becomes a 64-bit fingerprint (majority bits of its shingle
   hashes); equal fingerprints are one node from here on, so a group of
   thousands of copies costs one row.
2. A vantage-point tree splits the nodes by Hamming distance: a tree node has
   a vantage fingerprint and a radius (the median distance, from exact counts
   over all fingerprints); one job per level, and only counts per
   (shard, distance) reach the driver.
3. Each fingerprint has one home shard.  It also visits every shard that the
   triangle bound cannot rule out (|d(v, x) - radius| within the link
   distance), so shards that overlap at a boundary see each other's rows.
4. Inside a shard the same tree goes on in memory down to small buckets that
   are compared exactly.  A bucket too dense for the bounds to prune (a big
   ball of near copies) is resolved exactly by probing one-bit neighbours.
   A shard returns a spanning forest of its links, never all pairs.
5. Components of the links give the classes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fresh, stored, text_key, tune
from .components import components

SHINGLE = 3        # words per shingle
DISTANCE = 2       # most differing bits of a link
SHARD_ROWS = 4096  # fingerprints per shard at which the shared tree stops
MAX_SHARDS = 4096  # beyond SHARD_ROWS * MAX_SHARDS rows the shards grow instead of the tree
BLOCK = 1 << 19    # cells of one exact comparison
PROBE_KEYS = 1 << 21  # neighbour keys held at once in a dense bucket
ROOT_VANTAGE = 0x9E3779B97F4A7C15


# --- fingerprints ----------------------------------------------------------

def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text (0 when it has no words)."""
    words = (text or b"").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) > shingle:
        words = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    else:
        words = (b" ".join(words),)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), "<u8")
    ones = np.zeros(64, "i8")
    for part in range(0, len(h), 4096):
        bits = np.unpackbits(h[part:part + 4096].view("u1").reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_key, fp)`` for every row; ``fp`` as a signed long."""
    def run(it):
        for ids, texts, keys in batches(it, "doc_id", "text", "text_key"):
            fps = np.array([fingerprint(t, shingle) for t in texts], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()),
                                              pa.array(fps)], ["doc_id", "text_key", "fp"])
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"),
                         text_key("text").alias("text_key"))
    return narrow.mapInArrow(run, "doc_id long, text_key string, fp long")


# --- the shared tree -------------------------------------------------------

@dataclass
class Tree:
    """Vantage-point tree as flat lists; a leaf has no children (-1)."""
    vantage: list[int] = field(default_factory=lambda: [ROOT_VANTAGE])
    radius: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])

    def split(self, leaf: int, radius: int, vantages: tuple[int, int]) -> list[int]:
        n = len(self.vantage)
        self.radius[leaf], self.left[leaf], self.right[leaf] = radius, n, n + 1
        for v in vantages:
            for values, x in ((self.vantage, v), (self.radius, 0), (self.left, -1), (self.right, -1)):
                values.append(x)
        return [n, n + 1]

    def arrays(self):
        return (np.array(self.vantage, "<u8"), np.array(self.radius, "i4"),
                np.array(self.left, "i4"), np.array(self.right, "i4"))


def home_shard(fps: np.ndarray, tree) -> np.ndarray:
    vantage, radius, left, right = tree
    at = np.zeros(len(fps), "i4")
    while (inner := np.flatnonzero(left[at] >= 0)).size:
        node = at[inner]
        near = np.bitwise_count(fps[inner] ^ vantage[node]) <= radius[node]
        at[inner] = np.where(near, left[node], right[node])
    return at


def routes(fps: np.ndarray, tree, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of every shard that a fingerprint belongs to or must visit.

    A link between two homes that part at some tree node has its nearer end
    within ``distance`` of the radius; that end goes to the far side as a
    visitor and follows every branch the triangle bound leaves open.
    """
    vantage, radius, left, right = tree
    row, at, home = np.arange(len(fps)), np.zeros(len(fps), "i4"), np.ones(len(fps), bool)
    done = []
    while row.size:
        leaf = left[at] < 0
        done.append((row[leaf], at[leaf], home[leaf]))
        row, at, home = row[~leaf], at[~leaf], home[~leaf]
        d = np.bitwise_count(fps[row] ^ vantage[at]).astype("i4") - radius[at]
        near = d <= 0
        to_left = np.where(home, near, d - distance <= 0)
        to_right = np.where(home, ~near | (d + distance > 0), d + distance > 0)
        row, at, home = (np.concatenate([row[to_left], row[to_right]]),
                         np.concatenate([left[at[to_left]], right[at[to_right]]]),
                         np.concatenate([home[to_left], (home & ~near)[to_right]]))
    return tuple(np.concatenate(x) for x in zip(*done))


def build_tree(nodes: DataFrame, distance: int, shard_rows: int) -> Tree:
    """Grow the tree level by level from counts over all fingerprints."""
    total = nodes.count()
    rows = max(shard_rows, total // MAX_SHARDS)
    tree, growing = Tree(), [0] if total > rows else []
    while growing:
        arrays, active = tree.arrays(), np.array(growing, "i4")

        def count(it, arrays=arrays, active=active):
            for b in it:
                fps = b.column(0).to_numpy(zero_copy_only=False).view("<u8")
                at = home_shard(fps, arrays)
                keep = np.isin(at, active)
                fps, at = fps[keep], at[keep]
                cell = at.astype("i8") * 65 + np.bitwise_count(fps ^ arrays[0][at])
                mixed = (fps ^ np.uint64(ROOT_VANTAGE)) * np.uint64(0xFF51AFD7ED558CCD)
                order = np.lexsort((mixed, cell))
                cells, first, n = np.unique(cell[order], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), pa.array(n.astype("i8")),
                     pa.array(mixed[order][first].view("<i8")), pa.array(fps[order][first].view("<i8"))],
                    ["cell", "n", "mixed", "fp"])

        counts = (nodes.select("fp").mapInArrow(count, "cell long, n long, mixed long, fp long")
                  .groupBy("cell").agg(F.sum("n").alias("n"), F.min(F.struct("mixed", "fp")).alias("pick"))
                  .collect())
        spread: dict[int, dict[int, tuple]] = {}
        for c in counts:
            spread.setdefault(c["cell"] // 65, {})[c["cell"] % 65] = (c["n"], tuple(c["pick"]))
        growing = []
        for leaf, cells in sorted(spread.items()):
            n = sum(x[0] for x in cells.values())
            radius, below = None, 0
            for d in sorted(cells):
                below += cells[d][0]
                if 2 * below >= n:
                    radius = d
                    break
            # a split helps only if the far side, with its visitors, is clearly smaller
            visitors = sum(x[0] for d, x in cells.items() if radius - distance < d <= radius)
            if below == n or n - below + visitors > 0.95 * n:
                continue
            sides = [min(x[1] for d, x in cells.items() if (d <= radius) == near)[1] & (2**64 - 1)
                     for near in (True, False)]
            children = tree.split(leaf, radius, (sides[0], sides[1]))
            growing += [c for c, size in zip(children, (below, n - below)) if size > rows]
    return tree


# --- links inside a shard --------------------------------------------------

def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars with the same components as the links (a, b)."""
    names, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[:len(a)], idx[len(a):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tail = np.flatnonzero(label != np.arange(len(names)))
    return names[tail], names[label[tail]]


def _probe(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links at 2 bits or fewer of a dense set: two fingerprints link if and
    only if they share a word at distance 1 or less from both."""
    passes = -(-65 * len(fps) // PROBE_KEYS)
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype="<u8")])
    ends = []
    for p in range(passes):
        keys, owner = [], []
        for flip in flips:
            k = fps ^ flip
            mine = (((k * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(33)) % np.uint64(passes)) == p
            keys.append(k[mine])
            owner.append(fps[mine])
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        same = keys[1:] == keys[:-1]
        ends.append(forest(owner[:-1][same], owner[1:][same]))
    return tuple(np.concatenate(x) for x in zip(*ends))


def shard_links(home: np.ndarray, visit: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links among homes and between homes and visitors."""
    found, work = [(home[:0], home[:0])], [(home, visit)]
    while work:
        h, v = work.pop()
        if not h.size or h.size + v.size < 2:
            continue
        if h.size * (h.size + v.size) <= BLOCK:
            every = np.concatenate([h, v])
            i, j = np.nonzero(np.bitwise_count(h[:, None] ^ every[None, :]) <= distance)
            i, j = i[i < j], j[i < j]
            found.append(forest(h[i], every[j]) if len(i) > 2 * len(every) else (h[i], every[j]))
            continue
        vantage = h[(h ^ np.uint64(ROOT_VANTAGE)).argmin()]
        dh, dv = (np.bitwise_count(x ^ vantage).astype("i4") for x in (h, v))
        radius = int(np.partition(dh, len(dh) // 2)[len(dh) // 2])
        if radius == dh.max():
            radius -= 1
        near, cross = dh <= radius, (dh <= radius) & (dh + distance > radius)
        left = (h[near], v[dv - distance <= radius])
        right = (h[~near], np.concatenate([h[cross], v[dv + distance > radius]]))
        cost = sum(x.size * (x.size + y.size) for x, y in (left, right))
        if distance <= 2 and cost > 0.8 * h.size * (h.size + v.size):
            a, b = _probe(np.concatenate([h, v]))
            if distance < 2:  # the probe links up to two bits
                keep = np.bitwise_count(a ^ b) <= distance
                a, b = a[keep], b[keep]
            found.append((a, b))
            continue
        if cost >= h.size * (h.size + v.size):  # no gain from a split: compare in blocks
            step = max(1, BLOCK // (h.size + v.size))
            every = np.concatenate([h, v])
            for k in range(0, h.size, step):
                i, j = np.nonzero(np.bitwise_count(h[k:k + step, None] ^ every[None, :]) <= distance)
                i = i + k
                found.append(forest(h[i[i < j]], every[j[i < j]]))
            continue
        work += [left, right]
    a, b = (np.concatenate(x) for x in zip(*found))
    return forest(a, b) if a.size else (a, b)


# --- the operator ----------------------------------------------------------

def fingerprint_links(spark: SparkSession, nodes: DataFrame, distance: int = DISTANCE,
                      shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``nodes(fp)`` (distinct) -> links ``(u, v)`` that span every component."""
    tree = build_tree(nodes, distance, shard_rows).arrays()

    def route(it):
        for b in it:
            fps = b.column(0).to_numpy(zero_copy_only=False).view("<u8")
            row, shard, home = routes(fps, tree, distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(fps[row].view("<i8")), pa.array(home)],
                ["shard", "fp", "home"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, home = pdf["fp"].to_numpy().view("<u8"), pdf["home"].to_numpy(bool)
        a, b = shard_links(fps[home], fps[~home], distance)
        return pd.DataFrame({"u": a.view("<i8"), "v": b.view("<i8")})

    return (nodes.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
            .groupBy("shard").applyInPandas(link, "u long, v long"))


def simhash_groups(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE,
                   distance: int = DISTANCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, fp, component_id``.

    Null or blank texts have fingerprint 0 and link like any other.  A null
    ``doc_id`` is kept and never a component's id (unless all ids are null).
    Repeated rows each return a row.  An empty table gives an empty result.
    Other columns are ignored.
    """
    tune(spark)
    fps = stored(spark, fingerprints(docs, shingle), "fingerprints")
    nodes = stored(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    links = fingerprint_links(spark, nodes, distance, shard_rows)
    members = components(spark, links)
    linked = nodes.join(members, nodes["fp"] == members["node"])
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = stored(spark, (
        nodes.join(members.join(lows, "root").select(F.col("node").alias("fp"), "component_id"),
                   "fp", "left")
        .select("fp", F.coalesce("component_id", "low").alias("component_id"))), "classes")
    return fps.join(classes, "fp").select("doc_id", "text_key", "fp", "component_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE,
                         distance: int = DISTANCE) -> DataFrame:
    """Rows of ``docs`` without near duplicates: one row of each group stays,
    the one with the smallest ``doc_id`` (ties: smallest text digest)."""
    groups = stored(spark, simhash_groups(spark, docs, shingle, distance), "groups")
    # null ids: each fingerprint class without any id is its own group
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    kept = (groups.groupBy(group.alias("g")).agg(F.min(best).alias("best"))
            .select("best.doc_id", "best.text_key"))
    copies = groups.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    kept = stored(spark, kept.alias("k").join(
        copies.alias("c"), F.col("k.doc_id").eqNullSafe(F.col("c.doc_id"))
        & (F.col("k.text_key") == F.col("c.text_key"))).select("k.doc_id", "k.text_key", "copies"), "kept")
    key, rank = fresh(docs, "text_key"), fresh(docs, "row_rank")
    keyed = docs.withColumn(key, text_key("text"))

    def of(k: DataFrame) -> DataFrame:
        k = k.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text"))
        return keyed.join(k, keyed["doc_id"].cast("long").eqNullSafe(k["k_id"]) & (keyed[key] == k["k_text"]),
                          "left_semi")

    single = of(kept.where("copies = 1"))
    if kept.where("copies > 1").isEmpty():
        return single.drop(key)
    from pyspark.sql import Window
    repeated = of(kept.where("copies > 1")).withColumn(
        rank, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(
            *[F.col(f"`{c}`").cast("string") for c in docs.columns])))
    return single.unionByName(repeated.where(F.col(rank) == 1).drop(rank)).drop(key)
