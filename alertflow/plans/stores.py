"""Stores written from the derived frames, for the reader queries.

The reference's reader queries a stored table, so ours do too: the first
query of a session writes the store for a scale directory into the shared
work folder (as the ingest would, batch by batch) and later queries read it.
The store is data Spark derived from ``events``; its size grows with the
table, and it is written again when that table's files change.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import new_work_dir
from ..sources.store import STREAM, _fs, read_note, write_note, write_store
from . import fixtures as fx

_WRITTEN: dict[tuple, str] = {}


def _version(spark: SparkSession, path: str) -> tuple:
    """Changes when a table's files do."""
    fs, p = _fs(spark, path)
    at = fs.getFileStatus(p)
    files = fs.listStatus(p) if at.isDirectory() else [at]
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def _materialize(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name, _version(spark, f"{sf_dir}/events.parquet"))
    root = _WRITTEN.get(key)
    if root is None or read_note(spark, f"{root}/_ready") is None:
        root = new_work_dir(spark, f"store-{name}")
        build(spark, sf_dir, root)
        write_note(spark, f"{root}/_ready", "ok")
        _WRITTEN[key] = root
    return root


def _build_sec(spark, sf_dir, root):
    write_store(fx.store_rows(fx.sec(spark, sf_dir), batch_id=0), root, STREAM, 0)


def _build_redelivered(spark, sf_dir, root):
    # three arrivals: originals, redelivered copies, then the stale lower copies
    rows = fx.sec_redelivered(spark, sf_dir)
    seq = F.col("seq")
    parts = [seq < fx.REDELIVER_SEQ, (seq >= fx.REDELIVER_SEQ) & (seq < fx.STALE_SEQ),
             seq >= fx.STALE_SEQ]
    for batch, cond in enumerate(parts):
        write_store(fx.store_rows(rows.where(cond), batch_id=batch), root, STREAM, batch)


def _build_payload(spark, sf_dir, root):
    from ..operators.process import process, route
    from ..sources.codec import decode_events
    from ..sources.store import to_store_rows
    stored, _ = route(process(decode_events(fx.sec_payload(spark, sf_dir))))
    write_store(to_store_rows(stored, STREAM, 0, fx.FIXED_INGEST_TS), root, STREAM, 0)


def _build_ns(spark, sf_dir, root):
    write_store(fx.store_rows(fx.sec(spark, sf_dir), batch_id=0, timestamp=fx.ns_time()), root, STREAM, 0)


def ns_store(spark: SparkSession, sf_dir: str) -> str:
    """B1 with all events of an hour in one microsecond, told apart by
    nanoseconds, stored."""
    return _materialize(spark, sf_dir, "ns", _build_ns)


def payload_store(spark: SparkSession, sf_dir: str) -> str:
    """B3 decoded, processed and stored: what reached the store."""
    return _materialize(spark, sf_dir, "payload", _build_payload)


def _build_props(spark, sf_dir, root):
    s = fx.sec(spark, sf_dir, extra=("props",))
    wide = F.when(F.col("event_id") % fx.WIDE_MOD == 0, F.concat(F.lit("n"), F.repeat(F.lit("é"), fx.WIDE_CHARS))).otherwise("")
    s = s.withColumn("event_message", F.concat(wide, F.col("event_message"), F.lit(" props "),
                                               F.col("props"))).drop("props")
    write_store(fx.store_rows(s, batch_id=0), root, STREAM, 0)


def props_store(spark: SparkSession, sf_dir: str) -> str:
    """B1 with the event's ``props`` appended to the message and, in every fifth,
    two-byte characters around the cut (display truncation), stored."""
    return _materialize(spark, sf_dir, "props", _build_props)


def sec_store(spark: SparkSession, sf_dir: str) -> str:
    """B1 processed and stored (one batch)."""
    return _materialize(spark, sf_dir, "sec", _build_sec)


def redelivered_store(spark: SparkSession, sf_dir: str) -> str:
    """B2 processed and stored in three batches."""
    return _materialize(spark, sf_dir, "redelivered", _build_redelivered)
