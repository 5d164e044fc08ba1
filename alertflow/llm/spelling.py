"""Spelling variants: words one edit apart, found by pivotal grams.

Every word's bigrams are ordered from rare to common over the vocabulary.  The
``PREFIX`` rarest are its prefix; among them a dynamic programme picks two that
share no letter and are rarest together, its pivots.  One edit breaks only one
of two such pivots, so of two words one edit apart, the one whose prefix ends
earlier in the order has a pivot that the other one's prefix holds as well.

The position limits are exact: a pivot that is as far from the front in both
words has the edit behind it, one that is as far from the back has it before.
The letters on the other side of the edit are then equal, and they are part of
the join key, with both lengths.  What meets is verified by its edit distance.

Words are counted on the executors before any shuffle.  Only the bigram counts
(a bounded alphabet: at most 90 * 90) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, tune

RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS = 5
MIN_COUNT = 3
TYPO_EVERY = 97
GRAM = 2
PREFIX = GRAM + 1   # one edit breaks GRAM grams, so one of these stays
PIVOTS = 2          # one edit breaks one of two disjoint grams


# --- words -------------------------------------------------------------------

def lower_run(run: Column) -> Column:
    """A-Z to a-z only; a run without accented letters takes the fast way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(ascii_lower(run))


def with_typo(doc_id: Column, word: Column, every: int) -> Column:
    """``word``, without one letter where ``every`` divides the CRC-32 of ``doc_id:word``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    cut = F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))
    return F.when(h % every == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                typo_every: int | None = None) -> DataFrame:
    """``word, n`` of the letter runs of all texts that are long and frequent enough."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_chars).select("doc_id", lower_run(F.col("run")).alias("word"))
    if typo_every:
        runs = runs.select(with_typo(F.col("doc_id"), F.col("word"), typo_every).alias("word"))
    return (runs.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


# --- pivots ------------------------------------------------------------------

def grams(word: str) -> list[str]:
    return [word[i:i + GRAM] for i in range(len(word) - GRAM + 1)]


def gram_order(words: DataFrame) -> dict[str, int]:
    """Rank of every bigram, rarest first (at most the alphabet squared)."""
    places = F.sequence(F.lit(1), F.length("word") - GRAM + 1)
    each = words.select(F.explode(F.transform(places, lambda i: F.substr("word", i, F.lit(GRAM)))).alias("gram"))
    rows = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "gram").collect()
    return {r["gram"]: k for k, r in enumerate(rows)}


def prefix(word: str, order: dict[str, int]) -> tuple[int, list[int]]:
    """Rank of the last of the ``PREFIX`` rarest grams, and the places of all
    grams up to that rank."""
    ranks = [order[g] for g in grams(word)]
    last = sorted(ranks)[PREFIX - 1]
    return last, [i for i, r in enumerate(ranks) if r <= last]


def pivots(word: str, places: list[int], order: dict[str, int], wanted: int = PIVOTS) -> list[int]:
    """The ``wanted`` places of disjoint grams whose ranks have the smallest sum.

    ``best[k]`` holds, over the places seen so far, the cheapest choice of k
    grams; a gram may follow any choice that ends ``GRAM`` letters before it.
    """
    rank = [order[word[i:i + GRAM]] for i in places]
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * wanted]
    for n, place in enumerate(places):
        free = max((m + 1 for m in range(n) if places[m] + GRAM <= place), default=0)
        row = list(best[-1])
        for k in range(1, wanted + 1):
            before = best[free][k - 1]
            if before is not None and (row[k] is None or before[0] + rank[n] < row[k][0]):
                row[k] = (before[0] + rank[n], [*before[1], place])
        best.append(row)
    return best[-1][wanted][1]


def postings(word: str, order: dict[str, int]) -> Iterator[str]:
    """Keys under which a word is found: each prefix gram with all letters
    before it, and with all letters behind it."""
    for p in prefix(word, order)[1]:
        yield f"{len(word)}<{word[:p + GRAM]}"
        yield f"{len(word)}>{word[p:]}"


def probes(word: str, order: dict[str, int]) -> Iterator[str]:
    """Keys of the words that keep a pivot: as long, one longer or one shorter,
    with the edit behind the pivot (equal letters before it) or before it."""
    for p in pivots(word, prefix(word, order)[1], order):
        for size in (len(word) - 1, len(word), len(word) + 1):
            yield f"{size}<{word[:p + GRAM]}"
            yield f"{size}>{word[p:]}"


# --- Spark -------------------------------------------------------------------

def _keyed(words: DataFrame, order: dict[str, int], keys) -> DataFrame:
    """``word, n, last, key``: one row per distinct key of a word."""
    def run(it):
        for b in it:
            out = [(w, n, prefix(w, order)[0], key)
                   for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for key in set(keys(w, order))]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()))],
                ["word", "n", "last", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, last int, key string")


def near_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every word with every word one edit away.

    ``words`` has distinct words of at least four code points."""
    order = gram_order(words)
    a, b = _keyed(words, order, probes).alias("a"), _keyed(words, order, postings).alias("b")
    same = ((F.col("a.key") == F.col("b.key")) & (F.col("a.last") <= F.col("b.last"))
            & (F.levenshtein("a.word", "b.word", 1) == 1))
    # a pair can keep several grams: once is enough
    first = F.col("a.word") < F.col("b.word")
    side = lambda x, y: F.struct(F.col(f"{x}.word").alias("u"), F.col(f"{x}.n").alias("un"),
                                 F.col(f"{y}.word").alias("v"), F.col(f"{y}.n").alias("vn"))
    pairs = a.join(b, same).select(F.when(first, side("a", "b")).otherwise(side("b", "a")).alias("p")).select("p.*")
    pairs = pairs.distinct()
    return pairs.select(F.inline(F.array(
        F.struct(F.col("u").alias("word"), F.col("un").alias("n"), F.col("v").alias("near"), F.col("vn").alias("near_n")),
        F.struct(F.col("v").alias("word"), F.col("vn").alias("n"), F.col("u").alias("near"), F.col("un").alias("near_n")))))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of every chain of forms.

    Each round doubles the steps that a pointer spans.  A form is at least
    twice as frequent as its word, so chains are short and have no circles."""
    to = stored(spark, forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(spark, to.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        to = step.drop("moved")
        if step.where("moved").isEmpty():
            return to


def spelling_groups(spark: SparkSession, words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per row of ``words`` (``word, n``).

    ``form`` is the most frequent near word (ties: smallest in code-point
    order), if it is at least twice as frequent as the word; ``root`` is where
    following forms ends, the word itself if it has none.  An empty vocabulary
    gives an empty result.
    """
    tune(spark)
    words = stored(spark, words.select("word", "n"), "words")
    best = F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near"))
    near = near_words(spark, words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best"))
    fits = -F.col("best.order") >= 2 * F.col("n")
    found = stored(spark, words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.order")).alias("form_n")), "near-words")
    ends = roots(spark, found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(spark: SparkSession, docs: DataFrame, typo_every: int | None = None) -> DataFrame:
    """Spelling groups of the words of all texts.

    Null and empty texts have no words; a null ``doc_id`` counts as empty text
    where ``typo_every`` plants typos; repeated rows count each.  An empty
    table gives an empty result; extra columns are ignored.
    """
    return spelling_groups(spark, word_counts(docs, typo_every=typo_every))
