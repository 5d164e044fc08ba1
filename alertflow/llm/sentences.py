"""Substring dedup on sliding sentence spans.

From every sentence on, the run of ``RUN`` consecutive sentences (more, until it
has ``MIN_WORDS`` words; fewer, once it has ``LONG_WORDS``) is hashed (128 bits)
and joined over the whole corpus.  The first occurrence of a run, by document
id and position, stays; a sentence covered by any later occurrence goes.  Counting and finding
the first occurrence are combined before the shuffle, so a run that a third of
all documents share is no hot task.

What is left can still share a passage that holds no whole run.  So that every
shared passage of ``LONG_WORDS`` words loses some, the smallest hash of
``GRAM`` words in every window of as many words is compared the same way, within
sentences that stayed; later occurrences of those words go.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, stored, tune

RUN = 2          # sentences per span, at least
MIN_WORDS = 16   # a span of fewer words is no passage, so it goes on
LONG_WORDS = 50  # a span of so many words is complete, even one long sentence
GRAM = 25        # words compared inside a passage
# A sentence ends at a line break, or at . ! ? before a blank; its blanks stay with
# it.  One set of first characters, so that the search skips to them.
_ENDS = re.compile(r"[.!?\n](?:(?<=\n)|\s)\s*+(?=\S)")


def split_sentences(text: str | None) -> list[str]:
    """Sentences with their trailing blanks; joined they are the text."""
    if not text:
        return []
    out, at = [], 0
    for m in _ENDS.finditer(text, 0, len(text.rstrip())):  # no end in trailing blanks
        out.append(text[at:m.end()])
        at = m.end()
    return [*out, text[at:]]


def run_hashes(text: str | None, run: int, min_words: int,
               long_words: int = LONG_WORDS) -> list[tuple[int, int, int, int]]:
    """(first sentence, sentences, two halves of the 128-bit hash) of every run."""
    split = [s.split() for s in split_sentences(text)]
    parts = [" ".join(p) for p in split]
    words = np.cumsum([0] + [len(p) for p in split])
    # where a run from i may end: enough sentences and words, or very many words
    enough = np.maximum(np.arange(len(parts)) + run, np.searchsorted(words, words[:-1] + min_words))
    ends = np.minimum(enough, np.searchsorted(words, words[:-1] + long_words))
    out = []
    for i, end in enumerate(ends.tolist()):
        if end <= len(parts):
            h = blake2b("\n".join(parts[i:end]).encode(), digest_size=16).digest()
            out.append((i, end - i, int.from_bytes(h[:8], "little", signed=True),
                        int.from_bytes(h[8:], "little", signed=True)))
    return out


def gram_hashes(text: str | None, gone: set[int]) -> list[tuple[int, int, int, int]]:
    """(first word, words, two halves of the 128-bit hash) of the chosen grams
    of the sentences that stay; no gram reaches over a removed sentence."""
    out, at, words, start = [], 0, [], 0
    for i, part in enumerate([*split_sentences(text), None]):
        if part is None or i in gone:
            out += [(start + k, GRAM, *h) for k, h in _chosen(words)]
            at += len(words) + len((part or "").split())
            words, start = [], at
        else:
            words += part.split()
    return out


_CRC: dict[str, int] = {}
REMEMBER = 200_000   # words whose checksum a Python worker remembers
_FACTOR = 0x9E3779B97F4A7C15


def _crc(word: str) -> int:
    value = crc32(word.encode("utf-8", "surrogatepass"))
    if len(_CRC) < REMEMBER:
        _CRC[word] = value
    return value


def _rolled(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every ``size`` values in a row, by doubling."""
    done, have = None, 0            # hashes of the ``have`` values before a power of two
    power, step, factor = values, 1, _FACTOR
    while True:
        if size & step:
            n = len(values) - have - step + 1
            done = power if done is None else done[:n] * np.uint64(factor) + power[have:have + n]
            have += step
        if have == size:
            return done
        power = power[:-step] * np.uint64(factor) + power[step:]
        step, factor = 2 * step, factor * factor % 2 ** 64


def _last_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value (the last of equals) in every window, by doubling."""
    low, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        later = low[step:] <= low[:-step]
        low, at = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step])
        have += step
    return at


def _chosen(words: list[str]):
    """Winnowing: a smallest gram of every ``LONG_WORDS`` words, with its place."""
    width = LONG_WORDS - GRAM + 1
    if len(words) < LONG_WORDS:
        return
    get = _CRC.get
    each = np.array([_crc(w) if (c := get(w)) is None else c for w in words], "u8")
    n = len(words) - GRAM + 1
    grams = _rolled(each, GRAM)
    grams ^= grams >> np.uint64(29)
    places = _last_smallest(grams, width)
    # one step per stretch of windows with the same smallest gram
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    last, value = -1, None
    for end, place in zip([*first[1:].tolist(), len(places)], places[first].tolist()):
        # of equal grams the one already chosen serves as long as it is in the window
        if place == last or value == grams[place] and last + 1 >= end:
            continue
        last, value = place, grams[place]
        h = blake2b("\n".join(words[last:last + GRAM]).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        yield last, (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True))


def _gone(spans) -> set[int]:
    return {i for p in spans or () for i in range(p["place"], p["place"] + p["size"])}


def without(text: str | None, gone: set[int], words: set[int]) -> tuple[int, int, str]:
    """Sentences, those that went whole or in part, and the text left."""
    parts, at, cut, kept = split_sentences(text), 0, 0, []
    if not gone and not words:
        return len(parts), 0, text or ""
    for i, part in enumerate(parts):
        n = len(part.split()) if words else 0
        if i in gone:
            cut += 1
        elif words and not words.isdisjoint(range(at, at + n)):
            starts = [m.start() for m in re.finditer(r"\S+", part)] + [len(part)]
            kept.append(part[:starts[0]] + "".join(part[starts[k]:starts[k + 1]] for k in range(n) if at + k not in words))
            cut += 1
        else:
            kept.append(part)
        at += n
    return len(parts), cut, "".join(kept)


def _later(spark: SparkSession, rows: DataFrame, hashes, name: str) -> DataFrame:
    """Later occurrences of what ``hashes(text, spans)`` gives."""
    def scan(it):
        for ids, keys, texts, spans in batches(it, "doc_id", "row_key", "text", "spans"):
            out = [(d, k, *h) for d, k, t, s in zip(ids, keys, texts, spans) for h in hashes(t, s)]
            cols = list(zip(*out)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "row_key", "place", "size", "h1", "h2"])

    spans = stored(spark, rows.mapInArrow(
        scan, "doc_id long, row_key long, place int, size int, h1 long, h2 long"), name)
    # documents without an id come last
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "place")
    several = (spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
               .where("n > 1").select("h1", "h2", "first"))
    later = spans.join(stored(spark, several, f"repeated-{name}"), ["h1", "h2"]).where(at != F.col("first"))
    return later.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("place", "size"))).alias("spans"))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_key"))


def _copies_apart(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row of each (id, text), and the rows that repeat one (None without any).

    The keys that repeat are counted before any shuffle; only rows that hold
    one are stored, so that each can be told from the others."""
    key = ["no_id", "id", "row_key"]
    named = rows.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    several = stored(spark, named.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key),
                     "repeated-rows")
    if several.isEmpty():
        return rows, None
    held = stored(spark, named.join(several, key, "left_semi").withColumn("row", F.monotonically_increasing_id()),
                  "rows-that-repeat")
    first = held.groupBy(*key).agg(F.min("row").alias("row"))
    alone = named.join(several, key, "left_anti")
    one, others = held.join(first, [*key, "row"], "left_semi"), held.join(first, [*key, "row"], "left_anti")
    return alone.select(*rows.columns).unionByName(one.select(*rows.columns)), others.select(*rows.columns)


def remove_repeated_sentences(spark: SparkSession, docs: DataFrame, run: int = RUN,
                              min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_sentences, n_removed, kept`` per row of ``docs``; ``kept`` is the
    text left, ``n_removed`` the sentences that went whole or in part.

    Null and empty texts have no sentences; texts too short for a run stay.  Of
    rows that repeat both id and text (null ids too) one is the document and
    the others are its later copies; null ids count as the last documents.  An
    empty table gives an empty result; extra columns are ignored.
    """
    tune(spark)
    docs, copies = _copies_apart(spark, _narrow(docs))
    later = stored(spark, _later(spark, docs.withColumn("spans", F.lit(None)),
                                 lambda t, _: run_hashes(t, run, min_words), "sentence-spans"), "later-spans")

    def joined(d: DataFrame, p: DataFrame, column: str) -> DataFrame:
        p = p.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("spans").alias(column))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))
        return d.join(p, same, "left").drop("_id", "_key")

    whole = joined(docs, later, "spans")
    grams = stored(spark, _later(spark, whole, lambda t, s: gram_hashes(t, _gone(s)), "sentence-grams"), "later-grams")

    def keep(it):
        for ids, texts, spans, grams_ in batches(it, "doc_id", "text", "spans", "grams"):
            out = [(d, *without(t, _gone(s), _gone(g))) for d, t, s, g in zip(ids, texts, spans, grams_)]
            cols = list(zip(*out)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "n_sentences", "n_removed", "kept"])

    def keep_copy(it):  # every run and gram of a copy is a later occurrence
        for ids, texts in batches(it, "doc_id", "text"):
            out = []
            for d, t in zip(ids, texts):
                gone = {i for a, n, *_ in run_hashes(t, run, min_words) for i in range(a, a + n)}
                words = {i for a, n, *_ in gram_hashes(t, gone) for i in range(a, a + n)}
                out.append((d, *without(t, gone, words)))
            cols = list(zip(*out)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "n_sentences", "n_removed", "kept"])

    result = "doc_id long, n_sentences long, n_removed long, kept string"
    done = joined(whole, grams, "grams").select("doc_id", "text", "spans", "grams").mapInArrow(keep, result)
    return done if copies is None else done.unionByName(copies.select("doc_id", "text").mapInArrow(keep_copy, result))
