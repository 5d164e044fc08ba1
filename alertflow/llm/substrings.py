"""Exact substring dedup: bytes covered by a long string that also starts elsewhere.

1. Every ``span``-byte window of a text has an anchor: the k-gram with the
   smallest hash in it.  Equal windows have equal anchors at the same place, so
   windows can be compared per anchor hash.  Consecutive windows with the same
   anchor form one region; only hashes and offsets are shuffled.
2. Regions that are equal as a whole repeat as a whole (copies of any number
   cost one row each).  Regions that share an anchor hash but differ are
   contested; one text of each is fetched.
3. The suffix array of a contested group's regions (``suffix_array``: linear
   grouping) puts equal windows next to each other, which marks the starts.
   A group with more than ``GROUP_REGIONS`` regions is first cut into runs of
   ``CUTS`` starts, regrouped by the bytes all windows of a run have in common.
4. The marked starts, joined back to every document that holds the region,
   give the byte runs to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, stored, tune
from .suffix_array import suffix_array

SPAN = 400
GROUP_REGIONS = 1000   # regions compared in one suffix array
CUTS = (16, 1)         # starts per run when a larger group is cut
SEGMENT = 1 << 22      # starts scanned together in one text
_PLACE = (1 << 24) - 1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


# --- anchors ---------------------------------------------------------------

def gram_size(span: int) -> int:
    """Largest power of two of at most a third of the span."""
    return 1 << max(0, (span // 3).bit_length() - 1)


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` bytes (a power of two), by doubling."""
    h = (raw.astype("<u8") + np.uint64(1)) * _MIX[0]
    h ^= h >> np.uint64(29)
    n = 1
    while n < k:
        h = h[:-n] * _MIX[1] + h[n:]
        h ^= h >> np.uint64(31)
        n *= 2
    return h


def _window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo("u8").max, "<u8")]).reshape(-1, w)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[w - 1:w - 1 + n])


def regions(text: bytes, span: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor hash, lead, first start, last start, times): runs of windows with
    one anchor, ``lead`` bytes after the first start.  The runs partition all
    starts; a run that follows itself with the same bytes (periodic text, one
    character) comes once, with the number of times."""
    k = gram_size(span)
    for at in range(0, len(text) - span + 1, SEGMENT):
        part = np.frombuffer(text, "u1")[at:at + SEGMENT + span - 1]
        h = gram_hashes(part, k)
        key = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype="<u8")  # ties: the leftmost
        low = _window_minimum(key, span - k + 1)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.concatenate([first[1:], [len(low)]]) - 1
        place = (low[first] & np.uint64(_PLACE)).astype("i8")
        fp, lead = h[place].view("<i8"), place - first
        new = np.concatenate([[True], ~_follows(part, fp, lead, first, last, span)])
        head = np.flatnonzero(new)
        times = np.diff(np.concatenate([head, [len(first)]]))
        yield from zip(fp[head].tolist(), lead[head].tolist(), (first[head] + at).tolist(),
                       (last[head] + at).tolist(), times.tolist())


def _follows(part: np.ndarray, fp: np.ndarray, lead: np.ndarray, first: np.ndarray, last: np.ndarray,
             span: int) -> np.ndarray:
    """For every run but the first: does it hold the bytes of the run before it?"""
    width = last - first + 1
    same = (fp[1:] == fp[:-1]) & (lead[1:] == lead[:-1]) & (width[1:] == width[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view("i1"), [0]])))
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):  # stretches of alike runs: one width each
        w, lo, hi = int(width[a]), int(first[a]), int(last[z]) + span
        odd = np.concatenate([[0], np.cumsum(part[lo + w:hi] != part[lo:hi - w])])
        start = first[a:z] - lo
        same[a:z] = odd[start + w - 1 + span] == odd[start]
    return same


def digest64(raw: bytes) -> int:
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True)


# --- repeats inside one group ------------------------------------------------

def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _reach(parts: list[bytes]) -> list[int]:
    """Longest common prefix of each part with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    near = [_common(parts[a], parts[b]) for a, b in zip(order, order[1:])]
    out = [0] * len(parts)
    for k, i in enumerate(order):
        out[i] = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
    return out


def runs_of(starts: list[int]) -> list[tuple[int, int]]:
    """Sorted numbers as (first, last) runs."""
    out: list[list[int]] = []
    for s in starts:
        if out and s == out[-1][1] + 1:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [tuple(x) for x in out]


def repeats(group: list[tuple[int, bytes]], span: int) -> list[list[int]]:
    """For regions ``(lead, text)`` that share their anchor: the starts of each
    whose window also is a window of another."""
    left = _reach([text[:lead][::-1] for lead, text in group])
    right = _reach([text[lead:] for lead, text in group])
    joined, owner, offset = [], [], []
    at = 0
    for i, (lead, text) in enumerate(group):
        # a window that repeats lies within what the region shares on both sides
        lo, hi = lead - left[i], lead + right[i]
        if hi - lo >= span:
            joined.append(text[lo:hi])
            owner.append((at, at + hi - lo - span, i))
            offset.append(lo - at)
            at += hi - lo
    marked: list[list[int]] = [[] for _ in group]
    if len(joined) < 2:
        return marked
    whole = b"".join(joined)
    mine = [-1] * len(whole)
    for n, (a, z, _) in enumerate(owner):
        mine[a:z + 1] = [n] * (z - a + 1)
    previous, window = -1, b""
    hits = set()
    for s in suffix_array(whole):
        if mine[s] < 0:
            continue
        current = whole[s:s + span]
        if previous >= 0 and current == window:
            hits.update((previous, s))
        previous, window = s, current
    for s in sorted(hits):
        n = mine[s]
        marked[owner[n][2]].append(s + offset[n])
    return marked


# --- Spark -----------------------------------------------------------------

def _narrow(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"), F.xxhash64(raw).alias("row_key"))


def _scan(narrow: DataFrame, span: int) -> DataFrame:
    def run(it):
        for ids, raws, keys in batches(it, "doc_id", "raw", "row_key"):
            out = []
            for doc_id, raw, key in zip(ids, raws, keys):
                out += [(doc_id, key, fp, digest64(raw[a:z + span]), lead, a, z, times)
                        for fp, lead, a, z, times in regions(raw, span)]
            cols = list(zip(*out)) or [[]] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "row_key", "fp", "region", "lead", "first", "last", "times"])

    return narrow.mapInArrow(
        run, "doc_id long, row_key long, fp long, region long, lead int, first int, last int, times int")


def _fetch(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """Text of one holder of each wanted region: ``(fp, region, lead, raw)``."""
    per_doc = wanted.groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("fp", "region", "lead", "first", "last")).alias("parts"))

    def run(it):
        for raws, parts in batches(it, "raw", "parts"):
            out = [(p["fp"], p["region"], p["lead"], raw[p["first"]:p["last"] + span])
                   for raw, ps in zip(raws, parts) for p in ps]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                ["fp", "region", "lead", "raw"])

    d, p = docs.alias("d"), per_doc.alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.row_key") == F.col("p.row_key"))
    # repeated rows hold the same text: one is enough
    return (d.join(p, same).select("d.raw", "p.parts").mapInArrow(run, "fp long, region long, lead int, raw binary")
            .dropDuplicates(["fp", "region"]))


def _grouped(it: Iterator[pa.RecordBatch], *columns: str):
    rows = (row for cols in batches(it, "fp", *columns) for row in zip(*cols))
    return groupby(rows, key=lambda r: r[0])


def _compare(contested: DataFrame, span: int) -> DataFrame:
    """Suffix arrays of small groups: ``(fp, region, lo, hi)`` of repeated starts."""
    def run(it):
        for fp, rows in _grouped(it, "region", "lead", "raw"):
            rows = list(rows)
            out = [(fp, r[1], lo, hi) for r, starts in zip(rows, repeats([(r[2], r[3]) for r in rows], span))
                   for lo, hi in runs_of(starts)]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                    ["fp", "region", "lo", "hi"])

    return (contested.repartition("fp").sortWithinPartitions("fp")
            .mapInArrow(run, "fp long, region long, lo int, hi int"))


def _cut(large: DataFrame, step: int, span: int) -> DataFrame:
    """Regions as runs of ``step`` starts, keyed by the bytes their windows share.

    Runs lie at fixed distances from the anchor, so equal windows fall into
    equal runs, and every window of a run holds the run's core bytes."""
    def run(it):
        for fps, names, leads, raws in batches(it, "fp", "region", "lead", "raw"):
            out = []
            for fp, name, lead, raw in zip(fps, names, leads, raws):
                starts = len(raw) - span + 1
                for j in range(-lead // step, (starts - 1 - lead) // step + 1):
                    at = lead + j * step
                    lo, hi = max(at, 0), min(at + step, starts) - 1
                    core, part = raw[at + step - 1:at + span], raw[lo:hi + span]
                    out.append((fp, name, lo, digest64(b"%d:%d:" % (fp, j) + core),
                                digest64(b"%d:" % (at - lo) + part), at + step - 1 - lo, part))
            cols = list(zip(*out)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                ["whole_fp", "whole", "shift", "fp", "region", "lead", "raw"])

    return large.mapInArrow(
        run, "whole_fp long, whole long, shift int, fp long, region long, lead int, raw binary")


def _resolve(spark: SparkSession, contested: DataFrame, span: int, group_regions: int,
             cuts: tuple[int, ...]) -> DataFrame:
    """Repeated starts ``(fp, region, lo, hi)`` of distinct regions that share anchors."""
    sizes = contested.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(spark, sizes.where(F.col("n") > group_regions).select("fp"), "hot-anchors")
    if not cuts or hot.isEmpty():
        return _compare(contested, span)
    small = _compare(contested.join(hot, "fp", "left_anti"), span)
    parts = stored(spark, _cut(contested.join(hot, "fp", "left_semi"), cuts[0], span), "runs")
    same = (parts.groupBy("fp", "region").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("raw")).alias("size"))
            .where("n > 1").select("fp", "region", F.lit(0).alias("lo"), (F.col("size") - span).alias("hi")))
    mixed = (parts.groupBy("fp").agg(F.min("region").alias("a"), F.max("region").alias("b"))
             .where("a <> b").select("fp"))
    texts = stored(spark, parts.join(mixed, "fp", "left_semi").select("fp", "region", "lead", "raw")
                   .dropDuplicates(["fp", "region"]), "run-texts")
    inner = same.unionByName(_resolve(spark, texts, span, group_regions, cuts[1:]))
    place = parts.select("whole_fp", "whole", "shift", "fp", "region")
    return small.unionByName(place.join(inner, ["fp", "region"]).select(
        F.col("whole_fp").alias("fp"), F.col("whole").alias("region"),
        (F.col("shift") + F.col("lo")).alias("lo"), (F.col("shift") + F.col("hi")).alias("hi")))


def repeated_runs(spark: SparkSession, docs: DataFrame, span: int = SPAN,
                  group_regions: int = GROUP_REGIONS) -> DataFrame:
    """``doc_id, row_key, runs``: sorted runs of starts whose ``span`` bytes also
    start elsewhere, for every document that has any."""
    narrow = _narrow(docs)
    anchors = stored(spark, _scan(narrow, span), "anchors")
    shared = (anchors.groupBy("fp").agg(F.sum("times").alias("n"), F.min("region").alias("a"),
                                        F.max("region").alias("b"))
              .where("n > 1").select("fp", (F.col("a") != F.col("b")).alias("contested")))
    held = stored(spark, anchors.join(stored(spark, shared, "shared-anchors"), "fp"), "held")
    one = F.min(F.struct("doc_id", "row_key", "lead", "first", "last"))
    kinds = stored(spark, held.groupBy("fp", "region").agg(
        F.sum("times").alias("n"), F.first("contested").alias("contested"), one.alias("one")), "region-kinds")
    whole = kinds.where("n > 1").select("fp", "region", F.lit(0).alias("lo"),
                                        (F.col("one.last") - F.col("one.first")).alias("hi"))
    texts = stored(spark, _fetch(narrow, kinds.where("contested").select("fp", "region", "one.*"), span),
                   "region-texts")
    marks = stored(spark, whole.unionByName(_resolve(
        spark, texts, span, group_regions, tuple(c for c in CUTS if 2 * c <= span))), "marks")
    # a run that comes several times in a row repeats as a whole, up to the end of its last copy
    copies = (F.col("times") - 1) * (F.col("last") - F.col("first") + 1)
    run = F.struct((F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi") + copies).alias("stop"))
    return (held.join(marks, ["fp", "region"]).groupBy("doc_id", "row_key")
            .agg(F.array_sort(F.collect_set(run)).alias("runs")))


def _removed(runs, span: int) -> list[tuple[int, int]]:
    """Byte runs (start, end) that the windows of sorted start runs cover."""
    out: list[list[int]] = []
    for r in runs or ():
        a, z = r["start"], r["stop"] + span
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def remove_repeats(spark: SparkSession, docs: DataFrame, span: int = SPAN,
                   group_regions: int = GROUP_REGIONS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` per row of ``docs``; ``kept``
    holds the remaining bytes (a cut may fall inside a character).

    Null texts are empty; texts shorter than ``span`` stay whole; text of one
    character or a short period is one run, however long; equal texts
    of ``span`` bytes or more are removed whole, all of them.  Null ids and
    repeated rows each give a row.  An empty table gives an empty result;
    extra columns are ignored.
    """
    tune(spark)
    runs = stored(spark, repeated_runs(spark, docs, span, group_regions), "start-runs")

    def run(it):
        for ids, raws, found in batches(it, "doc_id", "raw", "runs"):
            out = []
            for doc_id, raw, r in zip(ids, raws, found):
                gone = _removed(r, span)
                at, kept = 0, []
                for a, z in gone:
                    kept.append(raw[at:a])
                    at = z
                kept.append(raw[at:])
                out.append((doc_id, len(raw), sum(z - a for a, z in gone), len(gone), b"".join(kept)))
            cols = list(zip(*out)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    d, r = _narrow(docs).alias("d"), runs.alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.row_key") == F.col("r.row_key"))
    return (d.join(r, same, "left").select("d.doc_id", "d.raw", "r.runs")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def kept_text(kept: str) -> Column:
    """The remaining bytes as text; a character that a cut went through shows as U+FFFD."""
    return F.make_valid_utf8(F.col(kept).cast("string"))
