"""Mixing sources to target weights by a min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources that a
   document belongs to): only words per pattern reach the driver.
2. A flow routes the words of every pattern to the quotas of its sources.  The
   first pass over a pattern is free and every further pass costs more, so the
   cheapest full flow repeats words evenly.  Patterns and sources that are not
   linked are solved apart, so single-source patterns cost nothing.
3. A pattern that gives ``q`` passes and ``r`` words takes every document ``q``
   times, and once more the documents that come first in a seeded order until
   ``r`` words are taken; the last of them is taken in part.  The document
   where that happens is found by descending through the digits of the order
   (sums of at most ``2 ** DIGIT`` buckets per pattern and level), so nothing
   is sorted, and no pattern lands in one task.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)      # repeating, over the sources in code-point order, null last
REPEATS = 3              # a document is taken at most so many times
SEED = 42
DIGIT = 12               # bits of the order per level
HASH_BITS = 60
MAX_PATTERNS = 100_000   # patterns are planned on the driver; more are refused


# --- targets -----------------------------------------------------------------

def source_order(names) -> list[str | None]:
    """By code point, null last."""
    return sorted((n for n in names if n is not None)) + [None] * (None in names)


def targets(sizes: Sequence[int], weights: Sequence[int], total: int, repeats: int = REPEATS) -> list[Fraction]:
    """Shares of ``total`` by weight; a target over ``repeats`` times its source's
    size stops there, and the excess goes to the others by weight."""
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    free, left = set(range(len(sizes))), Fraction(total)
    while free:
        share = left / sum(weights[i] for i in free)
        over = {i for i in free if share * weights[i] > repeats * sizes[i]}
        for i in over or free:
            out[i] = Fraction(repeats * sizes[i]) if over else share * weights[i]
        free -= over or free
        left -= sum(out[i] for i in over)
    return out


# --- flow --------------------------------------------------------------------

def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow on every arc ``(from, to, capacity, cost)`` of a cheapest maximum flow.

    Shortest augmenting paths over reduced costs (all costs are at least 0)."""
    to, left, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, room, price in arcs:
        for a, b, c, p in ((u, v, room, price), (v, u, 0, -price)):
            out[a].append(len(to))
            to.append(b), left.append(c), cost.append(p)
    height = [0] * n
    while True:
        far: list[float] = [float("inf")] * n
        via, far[start], heap = [-1] * n, 0, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                at = d + cost[e] + height[u] - height[to[e]]
                if left[e] and at < far[to[e]]:
                    far[to[e]], via[to[e]] = at, e
                    heapq.heappush(heap, (at, to[e]))
        if via[end] < 0:
            return [left[2 * k + 1] for k in range(len(arcs))]
        for v in range(n):
            height[v] += far[v] if far[v] < float("inf") else far[end]
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int],
          repeats: int = REPEATS) -> list[dict[int, int]]:
    """Words that every pattern ``(sources, words)`` gives to each of its sources.

    Quotas are filled as far as they can be; among such flows the one with the
    least cost is taken, where the k-th pass over a pattern costs k - 1 a word."""
    parent = list(range(len(quotas)))

    def find(s: int) -> int:
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            parent[find(s)] = find(members[0])
    linked = defaultdict(list)
    for k, (members, words) in enumerate(patterns):
        if members and words:
            linked[find(members[0])].append(k)
    gives: list[dict[int, int]] = [{} for _ in patterns]
    for group in linked.values():
        sources = sorted({s for k in group for s in patterns[k][0]})
        node = {s: 2 + len(group) + i for i, s in enumerate(sources)}
        arcs, routes = [], []
        for i, k in enumerate(group):
            members, words = patterns[k]
            arcs += [(0, 2 + i, words, done) for done in range(repeats)]
            for s in members:
                routes.append((len(arcs), k, s))
                arcs.append((2 + i, node[s], repeats * words, 0))
        arcs += [(node[s], 1, quotas[s], 0) for s in sources]
        flow = min_cost_flow(2 + len(group) + len(sources), arcs, 0, 1)
        for at, k, s in routes:
            if flow[at]:
                gives[k][s] = flow[at]
    return gives


# --- Spark -------------------------------------------------------------------

def word_count(text: Column | str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_place(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's place in the seeded order: from its id, or its text if it has none."""
    name = F.coalesce(F.concat(F.lit("id:"), doc_id.cast("string")), F.concat(F.lit("text:"), text), F.lit("none"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _digits() -> list[Column]:
    """The order of a pattern's documents, digit by digit: seeded place, then
    size, then row (documents equal in the first two count alike)."""
    out = []
    for name, bits in (("place", HASH_BITS), ("size", 36), ("row", 72)):
        for shift in range(bits - DIGIT, -1, -DIGIT):
            out.append(F.shiftright(name, shift).bitwiseAND((1 << DIGIT) - 1).cast("int"))
    return out


def _cuts(spark: SparkSession, narrow: DataFrame, rests: dict[str, int]) -> dict[str, tuple[list[int], int]]:
    """For every pattern with ``rest`` words to take: the digits of the document
    where the seeded order reaches them, and the words to take of it."""
    digits, open_, done = _digits(), {p: ([], r) for p, r in rests.items()}, {}
    for level, digit in enumerate(digits):
        if not open_:
            break
        at = spark.createDataFrame([(p, path, rest) for p, (path, rest) in open_.items()],
                                   "pattern string, path array<int>, rest long")
        here = narrow.join(F.broadcast(at), "pattern")  # at most MAX_PATTERNS rows
        if level:
            here = here.where(F.array(*digits[:level]) == F.col("path"))
        sums = here.groupBy("pattern", "rest", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("digit"))
        hit = (sums.withColumn("upto", upto).where((F.col("upto") >= F.col("rest"))
                                                   & (F.col("upto") - F.col("words") < F.col("rest"))))
        for r in hit.collect():
            path, rest = open_.pop(r["pattern"])
            found = ([*path, r["digit"]], rest - (r["upto"] - r["words"]))
            (done if r["n"] == 1 else open_)[r["pattern"]] = found
    return done | open_


def mix_sources(spark: SparkSession, docs: DataFrame, members: Column | None = None, weights: Sequence[int] = WEIGHTS,
                repeats: int = REPEATS, seed: int = SEED, keep: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """How many words the mix takes of every document.

    ``members`` is an array of the sources that a document belongs to (default:
    the one in ``source``; a null source is a source).  Returns two frames: the
    ``keep`` columns of ``docs`` with ``mix_pattern``, ``mix_size`` (words) and
    ``mix_taken`` (words taken, repeats counted: ``mix_taken div mix_size``
    whole copies and as many first words as remain); and the plan, ``source,
    source_size, target, quota, taken`` per source, where ``quota`` is the
    target without its fraction.

    Null and empty texts have no words and are taken zero times; documents of
    no source likewise.  Repeated rows count each.  An empty table gives empty
    frames.  A pattern's words fill its share exactly, so the sum taken for a
    source is its quota wherever the patterns have the words.
    """
    if members is None:
        members = F.array(F.col("source").cast("string"))
    text = F.col("text").cast("string")
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))))
    narrow = stored(spark, docs.select(
        *[F.col(c) for c in keep], pattern.alias("pattern"), word_count(text).alias("size"),
        seeded_place(F.col("doc_id"), text, seed).alias("place"),
        F.monotonically_increasing_id().alias("row")), "mixture")
    found = narrow.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    rows = sorted((r["pattern"], json.loads(r["pattern"]), r["words"]) for r in found)
    names = source_order({s for _, m, _ in rows for s in m})
    number = {s: i for i, s in enumerate(names)}
    each = [([number[s] for s in m], words) for _, m, words in rows]
    sizes = [0] * len(names)
    for m, words in each:
        for s in m:
            sizes[s] += words
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(names))],
                    sum(words for m, words in each if m), repeats)
    gives = route(each, [int(g) for g in goals], repeats)
    taken = [sum(g.get(i, 0) for g in gives) for i in range(len(names))]
    passes, rests = {}, {}
    for (name, _, words), given in zip(rows, gives):
        passes[name], rest = divmod(sum(given.values()), words) if words else (0, 0)
        if rest:
            rests[name] = rest
    cuts = _cuts(spark, narrow.select("pattern", "size", "place", "row"), rests)
    plan = spark.createDataFrame(
        [(p, q, *cuts.get(p, (None, None))) for p, q in passes.items()],
        "pattern string, passes long, path array<int>, rest long")  # at most MAX_PATTERNS rows
    here = F.slice(F.array(*_digits()), F.lit(1), F.size("path"))
    more = (F.when(F.col("path").isNull(), F.lit(0)).when(here < F.col("path"), F.col("size"))
            .when(here == F.col("path"), F.col("rest")).otherwise(F.lit(0)))
    mixed = narrow.join(F.broadcast(plan), "pattern").select(
        *keep, F.col("pattern").alias("mix_pattern"), F.col("size").alias("mix_size"),
        (F.col("passes") * F.col("size") + more).cast("long").alias("mix_taken"))
    sources = spark.createDataFrame(
        [(n, z, float(g), int(g), t) for n, z, g, t in zip(names, sizes, goals, taken)],
        "source string, source_size long, target double, quota long, taken long")
    return mixed, sources


def mixed_texts(mixed: DataFrame) -> DataFrame:
    """The mix itself, from a frame that keeps ``text``: a row per copy, with
    ``mix_copy`` from 0; a copy that is taken in part holds its first words."""
    whole, rest = F.expr("mix_taken div mix_size"), F.expr("mix_taken % mix_size")
    copies = F.when(F.col("mix_taken") > 0, F.sequence(F.lit(0), F.expr("(mix_taken - 1) div mix_size")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), rest.cast("int")), " ")
    out = mixed.withColumn("mix_copy", F.explode(copies))
    return out.withColumn("text", F.when(F.col("mix_copy") < whole, F.col("text")).otherwise(part))
