"""Best-fit packing, planned over a histogram of lengths.

The plan never sees documents: it is made from the number of pieces of each
length (at most ``capacity`` numbers, however large the corpus) and says, for
each length, which ranks go to which range of sequences at which offset.
Pieces then take their slots by a join on (length, rank).  Ranks inside one
length are a running sum over (length, scan task) counts, so a length that a
third of all pieces share is never one task's work.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, tune

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
# Words whose ids a Python worker remembers (a bound on its memory only:
# others are encoded again each time they come).
REMEMBER = 250_000
# Characters of text encoded together in a worker.
BATCH_CHARS = 3_000_000

# --- tokens ----------------------------------------------------------------

def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


_ENCODERS: dict[str, "Encoder"] = {}


# Fixed by the vocabulary file's own pattern: how it splits normalized text,
# written out for plain text (Latin letters that lower-case one to one and
# that normalization leaves alone).
NOT_PLAIN = r"[^\t-\r -~À-ÖØ-öø-įı-ſ]"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+"


class Encoder:
    """Ids of whole texts, by their distinct words.

    The tokenizer lower-cases, splits into words and merges inside words, so
    a text's ids are its words' ids in order.  Arrow splits a batch of plain
    texts and finds its distinct words, their ids are remembered, and numpy
    puts the ids back in text order.  Other texts (characters outside the
    plain set, or a special token's string) go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.is_end[i] = token.endswith(suffix)
        self.known: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _whole(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Encode words together; word ends in the ids tell them apart."""
        got = {}
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(
                [" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part):
                raw, stops = ids.tobytes(), (4 * ends).tolist()
                got.update(zip(part, (raw[a:b] for a, b in zip([0, *stops], stops))))
            else:
                got.update(zip(part, self._whole(part)))
        return got

    def _plain(self, texts: pa.Array) -> list[bytes]:
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), WORD, r"\0 ")
        for blank in "\t\n\v\f\r":
            apart = pc.replace_substring(apart, blank, " ")
        lists = pc.split_pattern(apart, " ")
        tokens = lists.flatten().dictionary_encode()
        distinct, index = tokens.dictionary.to_numpy(zero_copy_only=False).tolist(), tokens.indices.to_numpy()
        known = self.known
        new = self._words([w for w in distinct if w not in known])
        if len(known) + len(new) <= REMEMBER:
            known.update(new)
        ids = [new[w] if w in new else known[w] for w in distinct]
        size = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        per_word = size[index]
        ends = np.cumsum(per_word)
        total = int(ends[-1]) if len(ends) else 0
        raw = flat[np.repeat(start[index] - (ends - per_word), per_word) + np.arange(total)].tobytes()
        stops = (4 * np.concatenate([[0], ends])[lists.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(stops, stops[1:])]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, NOT_PLAIN)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        plain = iter(self._plain(texts.filter(pc.invert(odd))))
        whole = iter(self._whole(texts.filter(odd).to_pylist()))
        return [next(whole if o else plain) for o in odd.to_pylist()]


def _grouped(it):
    """Arrow batches joined to about BATCH_CHARS of text."""
    held, size = [], 0
    for b in it:
        held.append(b)
        size += b.column(1).nbytes
        if size >= BATCH_CHARS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size or any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, task, nth`` per piece.

    ``nth`` numbers the pieces of one length inside one scan task.
    """
    path = path or tokenizer_path()

    def run(it):
        encoder, task = Encoder.of(path), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        end = np.array([END_ID], "<u4").tobytes()
        for b in _grouped(it):
            out = []
            for doc_id, raw in zip(b.column(0).to_pylist(), encoder.encode(b.column(1))):
                raw += end
                for piece, k in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[k:k + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc_id, piece, k // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                                                       pa.int64(), pa.int32(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


# --- the plan --------------------------------------------------------------

def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit, longest first, over ``{length: pieces}``.

    Returns rows ``(length, rank_from, rank_to, first_sequence, offset)``: the
    pieces of that length with those ranks go to consecutive sequences from
    ``first_sequence``, each at ``offset``.  Open sequences are kept as runs
    of equal free room, so the work depends on the number of lengths only.
    """
    plan = []
    rooms: list[int] = []                        # sorted free rooms that occur
    runs: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, how many)
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in runs:
                runs[room] = []
                bisect.insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
                take = min(n, left)
                if take < n:
                    put(room, first + take, n - take)
            else:  # new sequences, each filled with as many as best-fit would put there
                room, first, take = capacity, sequences, left
                per = capacity // length
                take = -(-left // per)
                sequences += take
            plan.append((length, rank, rank + min(take, left), first, capacity - room))
            put(room - length, first, take)
            rank += min(take, left)
            left -= min(take, left)
    return plan


# --- the operator ----------------------------------------------------------

def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY,
         path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  A null text is empty (its only id is the end id); null ids and
    repeated rows are packed like any other row; documents longer than
    ``capacity`` are cut into full pieces and a rest.  An empty table gives
    an empty result; extra columns are ignored.
    """
    tune(spark)
    table = stored(spark, pieces(docs, path, capacity), "pieces")
    per_task = table.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(spark, per_task.select(
        "length", "task", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "piece-starts")
    # at most ``capacity`` rows, one per length
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(
        pd.DataFrame(plan_slots(counts, capacity),
                     columns=["length", "rank_from", "rank_to", "first_sequence", "offset"], dtype="int64"),
        "length long, rank_from long, rank_to long, first_sequence long, offset long")
    ranked = table.join(starts.select("length", "task", "before"), ["length", "task"]).withColumn(
        "rank", F.col("before") + F.col("nth"))
    # the plan has a few rows per length, whatever the corpus: safe to broadcast
    return (ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"])
                        & (ranked["rank"] >= plan["rank_from"]) & (ranked["rank"] < plan["rank_to"]))
            .select("doc_id", "piece", "start", ranked["length"], "ids_crc32",
                    (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
                    "offset"))
