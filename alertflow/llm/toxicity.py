"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their prefixes, hashed
into ``2 ** BITS`` slots.  The machine's score is a bias, a weight per term
and, for every pair of terms, the product of their factors (their sum divided
by the number of terms, so that long texts add no noise), so it can learn that
an insult counts more beside a group mention than both weights add up to.
Every term in ``MIN_DOCS`` sampled rows has a factor; one that is as often
toxic as the average has no weight of its own.
Training uses a bounded sample of labelled rows (``TRAIN_ROWS``, picked by a
seeded hash of their ids, and ``TRAIN_TERMS``); terms are extracted and the
machine is fitted on the executors, so the driver holds the model and no rows.
Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, bounded_sample, fresh, stored, tune

BITS = 18
FACTORS = 8
PREFIXES = (3, 4, 5, 6, 7)
TRAIN_ROWS = 20_000   # the documented bound on the rows the model is fitted on
TRAIN_TERMS = 20_000_000   # the same for the terms of these rows (about 1,000 a row)
BUCKETS = 1024        # parts that the sample is cut by
MIN_DOCS = 10         # a term in fewer training rows has neither weight nor factor
MIN_Z = 3.0           # no weight has one whose toxic share is this near the average, in standard errors
EPOCHS = 12
BATCH = 128
L2, FACTOR_L2 = 1e-4, 1e-2
SEED = 42
REMEMBER = 100_000    # words whose slots a Python worker remembers
# Separators: ASCII control, blank and punctuation bytes.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

_SLOTS: dict[bytes, tuple[int, ...]] = {}


def _slots(word: bytes) -> tuple[int, ...]:
    got = _SLOTS.get(word)
    if got is None:
        mask, text = (1 << BITS) - 1, word.decode("utf-8", "ignore")
        parts = [b"^" + text[:n].encode() for n in PREFIXES if len(text) >= n]
        got = tuple({zlib.crc32(p) & mask for p in (word, *parts)})
        if len(_SLOTS) < REMEMBER:
            _SLOTS[word] = got
    return got


def terms(text: str | bytes | None) -> np.ndarray:
    """Distinct hashed terms of one text, sorted."""
    raw = (text or "").lower().encode() if not isinstance(text, bytes) else text.decode().lower().encode()
    words = set(raw.translate(_WORDS).split())
    out: set[int] = set()
    for w in words:
        out.update(_slots(w))
    return np.array(sorted(out), "i4")


@dataclass
class Machine:
    """bias + sum of w_i + sum over pairs of <v_i, v_j> / number of terms with a
    factor, over a row's terms."""
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    @staticmethod
    def _flat(rows: list[np.ndarray]):
        size = np.array([len(r) for r in rows])
        return (np.concatenate(rows) if len(rows) else np.empty(0, "i4")).astype("i8"), size, np.repeat(
            np.arange(len(rows)), size)

    def _sums(self, slot, size, owner):
        n, k = len(size), self.factor.shape[1]
        linear = np.bincount(owner, self.weight[slot], n)
        v = self.factor[slot]
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        total, square, even = np.zeros((n, k), "f4"), np.zeros(n, "f4"), np.ones(n, "f4")
        some = size > 0
        if some.any():
            total[some] = np.add.reduceat(v, start[some], axis=0)
            squares = (v * v).sum(1)
            square[some] = np.add.reduceat(squares, start[some])
            even[some] = 1 / np.maximum(np.add.reduceat(squares > 0, start[some], dtype="i8"), 1)
        return linear, total, square, even, v

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        slot, size, owner = self._flat(rows)
        linear, total, square, even, _ = self._sums(slot, size, owner)
        return self.bias + linear + 0.5 * even * ((total * total).sum(1) - square)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(rows).astype("f8"), -30, 30)))


def telling(seen: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Which slots get a weight of their own, from the rows and the toxic rows that hold each."""
    error = np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    return (seen >= MIN_DOCS) & (np.abs(toxic - seen * share) >= MIN_Z * error)


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS,
        seed: int = SEED) -> Machine:
    """Logistic loss, adaptive gradient steps, small L2; seeded, so repeatable."""
    rng, slots = np.random.default_rng(seed), 1 << BITS
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1)))
    m = Machine(bias, np.zeros(slots, "f4"), np.zeros((slots, factors), "f4"))
    if not 0 < share < 1:
        return m
    seen, toxic = np.zeros(slots, "i8"), np.zeros(slots, "i8")
    for r, mark in zip(rows, labels):
        seen[r] += 1
        toxic[r] += mark
    used = seen >= MIN_DOCS
    terms_ = np.flatnonzero(used)       # numbered densely while fitting
    weighed, number = telling(seen, toxic, share)[terms_], np.cumsum(used, dtype="i4") - 1
    rows = [number[r[used[r]]] for r in rows]
    m = Machine(bias, np.zeros(len(terms_), "f4"), rng.normal(0, 0.01, (len(terms_), factors)).astype("f4"))
    gw, gv, rate = np.full(len(terms_), 1e-2, "f4"), np.full(len(terms_), 1e-2, "f4"), 0.1
    # each class has half of the weight
    heavy = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            pick = order[k:k + BATCH]
            slot, size, owner = m._flat([rows[i] for i in pick])
            linear, total, square, even, v = m._sums(slot, size, owner)
            z = m.bias + linear + 0.5 * even * ((total * total).sum(1) - square)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
            g = ((p - labels[pick]) * heavy[pick]).astype("f4")
            m.bias -= 0.02 * float(g.mean())
            if not slot.size:
                continue
            # sums per term of the batch, without sorting: terms are numbered densely
            at = np.flatnonzero(np.bincount(slot, minlength=len(terms_)))
            times = np.bincount(slot, minlength=len(terms_))[at]
            step = np.bincount(slot, g[owner], len(terms_))[at].astype("f4") + L2 * m.weight[at]
            step[~weighed[at]] = 0
            gw[at] += step * step
            m.weight[at] -= rate * step / np.sqrt(gw[at])
            pull = ((g * even)[:, None] * total)[owner] - (g * even)[owner][:, None] * v
            step = np.stack([np.bincount(slot, column, len(terms_))[at] for column in np.ascontiguousarray(pull.T)], 1)
            step = step.astype("f4") + (FACTOR_L2 * times).astype("f4")[:, None] * m.factor[at]
            gv[at] += (step * step).mean(1)
            m.factor[at] -= 0.5 * rate * step / np.sqrt(gv[at])[:, None]
    whole = Machine(m.bias, np.zeros(slots, "f4"), np.zeros((slots, factors), "f4"))
    whole.weight[terms_], whole.factor[terms_] = m.weight, m.factor
    return whole


# --- Spark -----------------------------------------------------------------

def is_held_out(doc_id: Column) -> Column:
    """Rows never trained on: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``terms, toxic`` of at most ``rows`` labelled documents (id and text)
    outside the held-out fold, with at most TRAIN_TERMS terms in all."""
    marked = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
              .where(~is_held_out(F.col("label_id"))))
    # at most ``rows`` ids and labels: a size bound, so the texts stay where they are
    pick = F.broadcast(bounded_sample(marked, "label_id", rows, marked.count(), SEED))
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .join(pick, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic"))
    # rows that repeat id and text are one document; one id can still have many texts
    sample = stored(spark, sample.distinct().withColumn("pair", F.xxhash64("doc_id", "text")), "toxicity-texts")
    sample = bounded_sample(sample, "pair", rows, sample.count(), SEED).select("pair", "text", "toxic")

    def extract(it):
        for pairs, texts, marks in batches(it, "pair", "text", "toxic"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs, pa.int64()), pa.array([terms(t) for t in texts], pa.list_(pa.int32())),
                 pa.array(marks, pa.int32())], ["pair", "terms", "toxic"])

    held = stored(spark, sample.mapInArrow(extract, "pair long, terms array<int>, toxic int"), "toxicity-sample")
    # the same for terms: of long texts fewer rows are taken, whole hash buckets up to the bound
    held = held.withColumn("bucket", F.pmod(F.xxhash64("pair", F.lit(SEED)), F.lit(BUCKETS)))
    sizes = held.groupBy("bucket").agg(F.sum(F.size("terms")).alias("terms")).orderBy("bucket").collect()
    upto = np.cumsum([r["terms"] for r in sizes] or [0])
    last = max((r["bucket"] for r, n in zip(sizes, upto) if n <= TRAIN_TERMS), default=-1)
    return held.where(F.col("bucket") <= last).select("terms", "toxic")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on ``training_rows`` in one task."""
    tune(spark)

    def learn(it):  # at most ``rows`` rows and TRAIN_TERMS terms: one task holds them
        slots, marks = [], []
        for b in it:
            column = b.column(0)
            cuts = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]
            slots += np.split(column.flatten().to_numpy().copy(), cuts)
            marks += b.column(1).to_pylist()
        order = sorted(range(len(slots)), key=lambda i: (slots[i].tobytes(), marks[i]))  # whatever order they came in
        m = fit([slots[i] for i in order], np.array([marks[i] for i in order]))
        at = np.flatnonzero((m.weight != 0) | m.factor.any(1)).astype("i4")
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.bias]), pa.array([at.tobytes()]), pa.array([m.weight[at].tobytes()]),
             pa.array([m.factor[at].tobytes()])], ["bias", "at", "weight", "factor"])

    # the driver gets the model alone: a number of terms with a factor times (FACTORS + 2) numbers
    held = training_rows(spark, docs, labels, rows)
    got = held.coalesce(1).mapInArrow(learn, "bias double, at binary, weight binary, factor binary").toArrow().to_pylist()
    m = Machine(0.0, np.zeros(1 << BITS, "f4"), np.zeros((1 << BITS, FACTORS), "f4"))
    for row in got:  # none if the sample has no partition
        at = np.frombuffer(row["at"], "i4")
        m.bias = row["bias"]
        m.weight[at] = np.frombuffer(row["weight"], "f4")
        m.factor[at] = np.frombuffer(row["factor"], "f4").reshape(-1, FACTORS)
    return m


def toxicity_score(spark: SparkSession, machine: Machine):
    """A column function: text -> score from 0 to 1 (null and empty texts: the bias)."""
    model = spark.sparkContext.broadcast(machine)  # fixed size: 2 ** BITS * (FACTORS + 1) numbers

    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.value.score([terms(t) for t in text]))

    return F.pandas_udf(score, "double")


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Only the text is an input of the score.  Null and empty texts get the
    machine's bias; a null ``doc_id`` is not held out and never trained on;
    equal texts have equal scores.  With no usable label the score is one
    constant.  Extra columns are ignored.
    """
    tune(spark)
    machine = train(spark, docs, labels)
    score = toxicity_score(spark, machine)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
            .select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a score below 0.5, with all their columns."""
    tune(spark)
    score = toxicity_score(spark, train(spark, docs, labels))
    name = fresh(docs, "toxicity_score")
    return docs.withColumn(name, score(F.col("text"))).where(F.col(name) < 0.5).drop(name)
