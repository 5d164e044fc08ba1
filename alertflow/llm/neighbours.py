"""Approximate nearest neighbours with learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into
balanced parts; a small classifier learns the parts from the vectors.  Every
vector goes to its most probable part (the index holds all rows); a query is
routed to its most probable parts, as many as a held-out part of the sample
needs for ``TARGET`` recall, and the candidates there are ranked by their exact
distance.  Parts are searched in blocks of a bounded number of rows, so a part
that holds very many (equal) vectors is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, stored, tune

K = 10
QUERY_EVERY = 100
SAMPLE_PER_PART = 128   # sampled vectors per part,
MAX_SAMPLE = 32_768     # at most so many in all: the documented bound of the fit
PARTS_PER_ROOT = 1 / 7  # the number of parts grows with the square root of the rows
MAX_PARTS = 4096        # and the model stays of bounded size
GRAPH_K = 10
HIDDEN = 128
EPOCHS = 30
TARGET = 0.95
BLOCK_ROWS = 8192       # index rows searched together
QUERY_ROWS = 16_384      # queries searched together
SEED = 42


# --- the fitted index ------------------------------------------------------

def _nearest(x: np.ndarray, y: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Indexes in ``y`` of the ``k`` nearest of each row of ``x`` (not itself if ``own``)."""
    out = np.empty((len(x), k), "i8")
    for a in range(0, len(x), 512):
        d = (y * y).sum(1)[None, :] - 2 * x[a:a + 512] @ y.T
        if own:
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        out[a:a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _halves(graph: np.ndarray, members: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Cut a part of the graph into two equal halves with few edges between:
    a smooth vector on the graph split at its median, then swaps that gain."""
    at = np.full(len(graph), -1)
    at[members] = np.arange(len(members))
    near = at[graph[members]]
    inside = near >= 0
    near = np.where(inside, near, 0)
    degree = np.maximum(inside.sum(1), 1)

    def spread(v):
        s = (v[near] * inside).sum(1)
        np.add.at(s, near.ravel(), (v[:, None] * inside).ravel())  # edges count both ways
        return s

    weight = spread(np.ones(len(members)))
    v = rng.normal(size=len(members))
    for _ in range(60):
        v = 0.5 * v + 0.5 * spread(v) / np.maximum(weight, 1)
        v -= np.average(v, weights=np.maximum(weight, 1))
        v /= np.linalg.norm(v) or 1.0
    side = np.zeros(len(members), bool)
    side[np.argsort(v, kind="stable")[len(members) // 2:]] = True
    for _ in range(8):
        pull = spread(np.where(side, 1.0, -1.0))      # > 0: more neighbours on the True side
        gain = np.where(side, -pull, pull)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        good = int((gain[a[:n]] + gain[b[:n]] > 0).sum()) // 2
        if not good:
            break
        side[a[:good]], side[b[:good]] = False, True
    return members[~side], members[side]


def balanced_parts(graph: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """Part of each node; ``parts`` is a power of two, sizes differ by a node or so."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [h for g in groups for h in _halves(graph, g, rng)]
    out = np.empty(len(graph), "i4")
    for p, g in enumerate(groups):
        out[g] = p
    return out


@dataclass
class Router:
    """A one-layer network: vector -> log-probability of each part."""
    center: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.center) * self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2


def fit_router(x: np.ndarray, parts: int, k: int = K, target: float = TARGET, seed: int = SEED) -> Router:
    """Neighbour graph, balanced parts and classifier of the sample ``x``."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    center = x.mean(0)
    scale = 1.0 / (float(x.std()) or 1.0)
    held = np.zeros(len(x), bool)
    held[rng.permutation(len(x))[:min(512, len(x) // 10)]] = True
    base, ask = x[~held], x[held]
    r = Router(center, scale, rng.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts), parts)
    if parts == 1 or len(base) <= max(GRAPH_K, k) or not len(ask):
        r.probes = parts
        return r
    graph = _nearest(base, base, GRAPH_K, own=True)
    part = balanced_parts(graph, parts, seed)
    # soft targets: the parts of a vector's neighbours and its own
    goal = np.zeros((len(base), parts))
    np.add.at(goal, (np.arange(len(base))[:, None], part[graph]), 1.0)
    goal[np.arange(len(base)), part] += GRAPH_K
    goal /= goal.sum(1, keepdims=True)
    z = (base - center) * scale
    state = [np.zeros((2,) + p.shape) for p in (r.w1, r.b1, r.w2, r.b2)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for a in range(0, len(order), 256):
            b = order[a:a + 256]
            h = np.maximum(z[b] @ r.w1 + r.b1, 0)
            o = h @ r.w2 + r.b2
            o = np.exp(o - o.max(1, keepdims=True))
            g = (o / o.sum(1, keepdims=True) - goal[b]) / len(b)
            gh = (g @ r.w2.T) * (h > 0)
            step += 1
            for p, grad, s in zip((r.w1, r.b1, r.w2, r.b2), (z[b].T @ gh, gh.sum(0), h.T @ g, g.sum(0)), state):
                s[0] = 0.9 * s[0] + 0.1 * grad
                s[1] = 0.999 * s[1] + 0.001 * grad * grad
                p -= 2e-3 * (s[0] / (1 - 0.9 ** step)) / (np.sqrt(s[1] / (1 - 0.999 ** step)) + 1e-8)
    # probes: the fewest parts that find the target share of the held-out rows' neighbours
    truth = r.logits(base).argmax(1)[_nearest(ask, base, k, own=False)]
    place = np.argsort(np.argsort(-r.logits(ask), axis=1, kind="stable"), axis=1)
    rank = np.take_along_axis(place, truth, axis=1)
    found = [(rank < t).mean() for t in range(1, parts + 1)]
    r.probes = next((t for t, f in enumerate(found, 1) if f >= target), parts)
    return r


# --- Spark -----------------------------------------------------------------

def _usable(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, v`` of the rows that take part; ``row`` tells rows of one id apart."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
            .where(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def number_of_parts(rows: int) -> int:
    """A power of two: two from 200 rows on, then with the square root of the rows."""
    parts = 1
    while parts < MAX_PARTS and 2 * parts <= max(rows ** 0.5 * PARTS_PER_ROOT, 2 * (rows >= 200)):
        parts *= 2
    return parts


def _search(base: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of one block for each query, by exact distance in double precision."""
    none = pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype(
        {"query_row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
    if base.empty or asked.empty:
        return none
    rows, ids, x = base["row"].to_numpy(), base["vec_id"].to_numpy(), np.stack(base["v"].to_numpy())
    norm, out = (x * x).sum(1), []
    queries = np.stack(asked["query_v"].to_numpy())
    for a in range(0, len(queries), 256):
        q = queries[a:a + 256]
        rough = norm[None, :] - 2 * q @ x.T + (q * q).sum(1)[:, None]
        slack = 1e-9 * (norm.max() + (q * q).sum(1))
        asks = zip(asked["query_row"].to_numpy()[a:a + 256], asked["query_id"].to_numpy()[a:a + 256], q)
        for row, (own, qid, qv) in enumerate(asks):
            rough[row, rows == own] = np.inf
            edge = np.partition(rough[row], min(k, len(ids)) - 1)[min(k, len(ids)) - 1]
            near = np.flatnonzero(rough[row] <= edge + slack[row]) if np.isfinite(edge) else np.flatnonzero(
                np.isfinite(rough[row]))
            d = np.sqrt(((x[near] - qv) ** 2).sum(1))
            best = np.lexsort((ids[near], d))[:k]
            out.append(pd.DataFrame({"query_row": np.full(len(best), own), "query_id": np.full(len(best), qid), "vec_id": ids[near][best], "score": d[best]}))
    return pd.concat(out) if out else none


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY,
                       block_rows: int = BLOCK_ROWS, target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found per query.

    Queries are the ids divisible by ``query_every``; every other row is a
    candidate.  Null, all-zero and non-finite vectors and null ids take no
    part, nor do vectors of another length than the most common one.  Rows that
    repeat an id are rows of their own: each is a candidate for all others,
    and each asks if the id does, so their ranks come once per row.  Ties rank
    by id.  An empty table gives an empty result; extra columns are ignored.
    """
    tune(spark)
    rows = stored(spark, _usable(vectors), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    dim, total = sizes["d"], sizes["n"]
    rows = rows.where(F.size("v") == dim)
    parts = number_of_parts(total)
    sample = (bounded_sample(rows, "row", min(parts * SAMPLE_PER_PART, MAX_SAMPLE), total, SEED).toArrow()
              .sort_by("row").column("v").combine_chunks())
    router = fit_router(sample.flatten().to_numpy().reshape(-1, dim), parts, k, target)
    sent = spark.sparkContext.broadcast(router)  # fixed size: (dim + parts) * HIDDEN numbers

    def route(it):
        for b in it:
            v = b.column(2)
            order = np.argsort(-sent.value.logits(v.flatten().to_numpy().reshape(-1, dim)), axis=1, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), v,
                 pa.array(list(order[:, :sent.value.probes].astype("i4")), pa.list_(pa.int32()))],
                ["row", "vec_id", "v", "parts"])

    routed = stored(spark, rows.mapInArrow(route, "row long, vec_id long, v array<double>, parts array<int>"), "routed")
    index = routed.select("row", "vec_id", "v", F.col("parts")[0].alias("part"))
    asked = routed.where(F.col("vec_id") % query_every == 0).select(
        F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("query_v"), F.explode("parts").alias("part"))

    def blocks(df: DataFrame, size: int) -> dict[int, int]:  # at most MAX_PARTS rows
        return {r["part"]: -(-r["n"] // size) for r in df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}

    def of(counts: dict[int, int]):
        pairs = [F.lit(x) for p, n in counts.items() for x in (p, n)]
        return F.coalesce(F.create_map(*pairs)[F.col("part")], F.lit(1)) if pairs else F.lit(1)

    index_blocks, query_blocks = of(blocks(index, block_rows)), of(blocks(asked, QUERY_ROWS))
    # every block of a part meets every block of its queries
    index = index.withColumn("block", F.pmod(F.xxhash64("row"), index_blocks).cast("int")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("query_row"), query_blocks).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), index_blocks - 1)))
    keys = ["part", "block", "turn"]
    found = (index.groupBy(*keys).cogroup(asked.groupBy(*keys))
             .applyInPandas(lambda a, b: _search(a, b, k), "query_row long, query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
