"""Benchmark contamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item
is one window).  Every text is cut into k-grams of words; of the k-gram hashes
in each window the smallest is a fingerprint.  A window that occurs in a
document has the same smallest k-gram there, so both sides keep it: no shared
window is missed.  Documents whose fingerprints meet the benchmark's are
extended to the whole windows around the hit, and those are compared exactly
(by a 128-bit digest of their words).

The benchmark's fingerprints are sent to the executors while they are few
(``SEND_FPS``, 8 bytes each); beyond that the document fingerprints are joined
to them by a shuffle.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, stored, text_key, tune

WINDOW = 13
GRAM = 8
SHARE = 20              # contaminated: SHARE * hit words >= words
SEND_FPS = 2_000_000    # benchmark fingerprints that executors may hold (16 MB)
BUFFER = 1 << 20        # bytes of text fingerprinted together

# Word characters: 0-9, a-z (A-Z lower-cased) and everything beyond ASCII.
_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else
               c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))

# Powers of the base and of its inverse (mod 2^64), for positions in a buffer.
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), base, "<u8")
        p[0] = 1
        _POWERS[base] = np.cumprod(p)
    return _POWERS[base]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word: running sums over the joined bytes, buffer by buffer."""
    out, at = [np.empty(0, "<u8")], 0
    size = np.fromiter(map(len, words), "i8", len(words))
    while at < len(words):
        end = at + max(1, int(np.searchsorted(np.cumsum(size[at:at + BUFFER]), BUFFER, "right")))
        raw = np.frombuffer(b"".join(words[at:end]), "u1").astype("<u8") + np.uint64(1)
        run = np.concatenate([np.zeros(1, "<u8"), np.cumsum(raw * _powers(_BASE, len(raw))[:len(raw)])])
        stop = np.cumsum(size[at:end])
        start = stop - size[at:end]
        out.append(_mixed((run[stop] - run[start]) * _powers(pow(_BASE, -1, 1 << 64), len(raw))[start]))
        at = end
    return np.concatenate(out)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, "<u8")
    g = np.zeros(n, "<u8")
    for j in range(k):
        g = g * np.uint64(_BASE) + h[j:j + n]
    return _mixed(g)


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    n = len(x) - w + 1
    out = x[:n].copy()
    for j in range(1, w):
        pick(out, x[j:n + j], out=out)
    return out


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of every ``w`` consecutive ones (all of them on ties)."""
    if w == 1:
        return np.arange(len(g))
    if len(g) < w:
        return np.empty(0, "i8")
    low = _slide(g, w, np.minimum)
    # a position is kept if it is the smallest of some window around it
    edge = np.concatenate([np.zeros(w - 1, "<u8"), low, np.zeros(w - 1, "<u8")])
    return np.flatnonzero(_slide(edge, w, np.maximum) == g)


def classes(lengths: Iterable[int], window: int, gram: int) -> dict[int, tuple[int, int]]:
    """Window length -> (k, hashes per window)."""
    return {n: (min(gram, n), n - min(gram, n) + 1) for n in sorted(set(lengths)) if 0 < n <= window}


def window_digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


# --- Spark -----------------------------------------------------------------

_WINDOWS = pa.list_(pa.struct([("length", pa.int32()), ("start", pa.int32()), ("digest", pa.binary())]))
SCANNED = ("doc_id long, text_key string, n_words long, "
           "windows array<struct<length: int, start: int, digest: binary>>")


def _scanned(ids, keys, n_words, windows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(n_words, pa.int64()),
         pa.array(windows, _WINDOWS)], ["doc_id", "text_key", "n_words", "windows"])


def _window(words: list[bytes], length: int, start: int, doc_start: int = 0) -> dict:
    return {"length": length, "start": start - doc_start, "digest": window_digest(words[start:start + length])}


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"),
                       F.col("text").cast("binary").alias("text"))


def _item_tables(spark: SparkSession, benchmark: DataFrame, window: int, gram: int):
    """Windows ``(length, digest, item_id)`` and fingerprints ``(length, fp)`` of all items."""
    def run(it):
        for ids, texts in batches(it, "item_id", "text"):
            rows = []
            for item, text in zip(ids, texts):
                words = words_of(text)
                if not words:
                    continue
                n = min(window, len(words))
                k, w = classes([n], window, gram)[n]
                g = gram_hashes(word_hashes(words), k)
                fps = np.unique(g[winnow(g, w)]).view("<i8").tolist()
                digests = {window_digest(words[s:s + n]) for s in range(len(words) - n + 1)}
                rows.append((item, n, sorted(digests), fps))
            cols = list(zip(*rows)) or [[]] * 4
            types = (pa.string(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["item_id", "length", "digests", "fps"])

    items = stored(spark, benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                                           F.col("text").cast("binary").alias("text"))
                   .mapInArrow(run, "item_id string, length int, digests array<binary>, fps array<long>"),
                   "benchmark-windows")
    windows = items.select("length", F.explode("digests").alias("digest"), "item_id").distinct()
    fps = items.select("length", F.explode("fps").alias("fp")).distinct()
    return windows, fps


def _scan(docs: DataFrame, sizes: dict[int, tuple[int, int]], sent) -> DataFrame:
    """``doc_id, text_key, n_words, windows`` of each row, windows only around shared fingerprints."""
    def run(it):
        known = sent.value
        for ids, keys, texts in batches(it, "doc_id", "text_key", "text"):
            each = [words_of(t) for t in texts]
            size = np.fromiter(map(len, each), "i8", len(each))
            stop = np.cumsum(size)
            words = [w for ws in each for w in ws]
            h = word_hashes(words)
            grams = {k: gram_hashes(h, k) for k in {k for k, _ in sizes.values()}}
            found: list[list] = [[] for _ in ids]
            for length, (k, w) in sizes.items():
                # the batch is one run of words: grams across two documents only add candidates
                at = winnow(grams[k], w)
                at = at[np.isin(grams[k][at], known[length])]
                starts = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
                owner = np.searchsorted(stop, starts, "right")
                ok = (starts >= 0) & (owner < len(ids))
                starts, owner = starts[ok], owner[ok]
                inside = starts + length <= stop[owner]
                for s, d in zip(starts[inside].tolist(), owner[inside].tolist()):
                    found[d].append(_window(words, length, s, int(stop[d] - size[d])))
            yield _scanned(ids, keys, size, found)

    return _narrow(docs).mapInArrow(run, SCANNED)


def _scan_by_join(spark: SparkSession, docs: DataFrame, fps: DataFrame,
                  sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """As ``_scan`` when the benchmark's fingerprints are too many to send."""
    def grams_of(it):
        for keys, texts in batches(it, "text_key", "text"):
            for key, text in zip(keys, texts):
                h = word_hashes(words_of(text))
                for length, (k, w) in sizes.items():
                    g = gram_hashes(h, k)
                    at = winnow(g, w)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(at), pa.string()), pa.array([length] * len(at), pa.int32()),
                         pa.array(g[at].view("<i8")), pa.array(at.astype("i4"))],
                        ["text_key", "length", "fp", "at"])

    def extend(it):
        for ids, keys, texts, hits in batches(it, "doc_id", "text_key", "text", "hits"):
            n_words, found = [], []
            for text, hit in zip(texts, hits):
                words = words_of(text)
                n_words.append(len(words))
                todo = sorted({(x["length"], x["at"] - j) for x in hit or ()
                               for j in range(sizes[x["length"]][1])})
                found.append([_window(words, n, s) for n, s in todo if s >= 0 and s + n <= len(words)])
            yield _scanned(ids, keys, n_words, found)

    narrow = _narrow(docs)
    grams = narrow.select("text_key", "text").mapInArrow(
        grams_of, "text_key string, length int, fp long, at int")
    hits = (grams.join(fps, ["length", "fp"], "left_semi")
            .groupBy("text_key").agg(F.collect_set(F.struct("length", "at")).alias("hits")))
    return narrow.join(stored(spark, hits, "fingerprint-hits"), "text_key", "left").select(
        "doc_id", "text_key", "text", "hits").mapInArrow(extend, SCANNED)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  gram: int = GRAM, share: int = SHARE, send_fps: int = SEND_FPS) -> DataFrame:
    """``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated`` per row of ``docs``.

    Null texts have no words and no hits; items without words have no
    windows; a null ``item_id`` is not counted among the items, though its
    windows hit.  Repeated rows each return a row; equal texts have equal
    results.  Empty tables give an empty result (documents) or no hits
    (benchmark).  Extra columns are ignored.
    """
    tune(spark)
    windows, fps = _item_tables(spark, benchmark, window, gram)
    lengths = [r["length"] for r in fps.select("length").distinct().collect()]  # at most ``window`` rows
    sizes = classes(lengths, window, gram)
    if fps.count() <= send_fps:
        known: dict[int, list[int]] = {n: [] for n in sizes}
        for r in fps.collect():
            known[r["length"]].append(r["fp"])
        sent = spark.sparkContext.broadcast({n: np.array(v, "<i8").view("<u8") for n, v in known.items()})
        scanned = _scan(docs, sizes, sent)
    else:
        scanned = _scan_by_join(spark, docs, fps, sizes)
    scanned = stored(spark, scanned, "scanned")

    texts = (scanned.where(F.size("windows") > 0)
             .groupBy("text_key").agg(F.first("windows").alias("windows")))  # equal texts: equal windows
    hits = stored(spark, texts.select("text_key", F.explode("windows").alias("w"))
                  .select("text_key", "w.start", "w.length", "w.digest")
                  .join(windows, ["length", "digest"]).select("text_key", "start", "length", "item_id"),
                  "window-hits")
    spans = hits.groupBy("text_key", "start").agg(F.max(F.col("start") + F.col("length")).alias("stop"))
    reached = F.max("stop").over(Window.partitionBy("text_key").orderBy("start")
                                 .rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))
    covered = (spans.withColumn("reached", F.coalesce(reached, F.lit(0)))
               .groupBy("text_key").agg(F.sum(new).cast("long").alias("n_hit")))
    items = hits.groupBy("text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    per_text = stored(spark, covered.join(items, "text_key").select(
        "text_key", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "contaminated-texts")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return scanned.select("doc_id", "text_key", "n_words").join(per_text, "text_key", "left").select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text is not contaminated, with all their columns."""
    bad = stored(spark, contamination(spark, docs, benchmark).where("contaminated")
                 .select(F.col("text_key").alias("contaminated_text")).distinct(), "contaminated")
    return docs.join(bad, text_key(docs["text"]) == bad["contaminated_text"], "left_anti")
