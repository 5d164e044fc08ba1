"""The event store: an append log of parquet batches, resolved on read.

Layout under ``root``::

    log/source=S/batch_id=N/part-*.parquet      the rows, sorted by date and severity
    counts/source=S/batch_id=N/part-*.parquet   identities per date and severity
    counters/source=S/batch_id=N/part-*.parquet stored, invalid and malformed rows

``S`` names one ingest lineage (one checkpoint, or the replays), so batch
numbers of two writers, or of a writer whose checkpoint was thrown away, never
meet.  A micro-batch overwrites only its own directory: a batch that runs again
replaces itself.  Nothing is ever moved, folded or deleted, so a row that was
written once is read for ever; reads resolve the log with latest-wins.  Files
carry ``event_date`` and ``severity`` in order, so filters on them skip row
groups.  Nothing here needs MERGE.
"""

from __future__ import annotations

import datetime as _dt

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import latest_wins
from ..schema import STORED_SCHEMA

STREAM = "stream"
REPLAY = "replay"
_STORED_COLS = [f.name for f in STORED_SCHEMA.fields]
_DATA_COLS = [c for c in _STORED_COLS if c not in ("source", "batch_id")]
COUNTS_SCHEMA = T.StructType([
    T.StructField("event_date", T.DateType()),
    T.StructField("severity", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])
COUNTERS_SCHEMA = T.StructType([
    T.StructField("processed", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("malformed", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])


def to_store_rows(stored: DataFrame, source: str, batch_id: int,
                  ingest_ts: _dt.datetime | None = None) -> DataFrame:
    """Stored rows of ``process`` → ``STORED_SCHEMA`` with arrival columns."""
    if ingest_ts is None:
        ingest_ts = _dt.datetime.now(_dt.timezone.utc)
    ts_text = ingest_ts.astimezone(_dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
    cols = {
        "time": F.col("time").cast("timestamp"),
        "time_ns_rem": F.col("time_ns_rem").cast("smallint"),
        "criticality": F.col("criticality").cast("bigint"),
        "event_message": F.col("event_message"),
        "severity": F.col("severity"),
        "event_date": F.col("event_date"),
        "ingest_ts": F.lit(ts_text).cast("timestamp"),
        "source": F.lit(source),
        "batch_id": F.lit(batch_id).cast("bigint"),
        "ingest_seq": F.col("ingest_seq").cast("bigint"),
    }
    return stored.select(*[col.alias(name) for name, col in cols.items()])


def batch_path(root: str, source: str, batch_id: int, area: str = "log") -> str:
    return f"{root}/{area}/source={source}/batch_id={batch_id}"


def write_store(rows: DataFrame, root: str, source: str, batch_id: int) -> None:
    """Write one batch of store rows, replacing that batch if it was written before.

    ``rebalance`` lets AQE size the files.  The batch's identities per date
    and severity are counted from the files just written.  The counts are the
    zone map of newest-first reads, which see a batch once its counts are
    there, that is, when this function returns; a call that fails has to be
    made again.
    """
    path = batch_path(root, source, batch_id)
    (rows.select(*_DATA_COLS).hint("rebalance").sortWithinPartitions("event_date", "severity")
     .write.mode("overwrite").parquet(path))
    written = rows.sparkSession.read.schema(
        T.StructType([f for f in STORED_SCHEMA.fields if f.name in _DATA_COLS])).parquet(path)
    (written.groupBy("event_date", "severity").agg(F.count_distinct("time", "time_ns_rem").alias("n"))
     .coalesce(1).write.mode("overwrite").parquet(batch_path(root, source, batch_id, "counts")))


# --- small files beside the data (lineage names, arrival clock) ---------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_note(spark: SparkSession, path: str) -> str | None:
    """The text of a one-line file, or None."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def drop_note(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, False)


def create_once(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already.  Of several callers
    at once one succeeds (local files: exclusive creation; other file systems:
    their create without overwrite, atomic on HDFS)."""
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    try:
        fs.mkdirs(p.getParent())
        if fs.getScheme() == "file":
            jvm.java.nio.file.Files.createFile(
                jvm.java.io.File(p.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(
                    jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(p, False).close()
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


TICKETS_KEPT = 32   # older tickets are removed: only the newest one counts


def arrival_time(spark: SparkSession, root: str) -> _dt.datetime:
    """Now, but always later than any time given out for this store before,
    however many writers ask at once.

    A time is a ticket: an empty file named by its microseconds, made by one
    writer only, and given out if no later ticket is there yet."""
    folder, epoch = f"{root}/_tickets", _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)
    while True:
        there = sorted(int(n) for n in _names(spark, folder) if n.isdigit())
        now = (_dt.datetime.now(_dt.timezone.utc) - epoch) // _dt.timedelta(microseconds=1)
        mine = max(now, there[-1] + 1 if there else 0)
        if create_once(spark, f"{folder}/{mine:020d}") and max(
                int(n) for n in _names(spark, folder) if n.isdigit()) == mine:
            for old in there[:-TICKETS_KEPT]:
                fs, p = _fs(spark, f"{folder}/{old:020d}")
                fs.delete(p, False)
            return epoch + _dt.timedelta(microseconds=mine)


def claim_batch(spark: SparkSession, root: str, source: str) -> int:
    """The next batch number of ``source``, for this caller alone."""
    folder = f"{root}/_claims/{source}"
    while True:
        taken = [int(n) for n in _names(spark, folder) if n.isdigit()]
        mine = max([*taken, *list_batches(spark, root).get(source, [])], default=-1) + 1
        if create_once(spark, f"{folder}/{mine}"):
            return mine


def list_batches(spark: SparkSession, root: str) -> dict[str, list[int]]:
    """Batch numbers present in the log, per source (directory listing only)."""
    def dirs(path: str) -> list[str]:
        fs, p = _fs(spark, path)
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

    return {s.split("=", 1)[1]: sorted(int(b.split("=", 1)[1]) for b in dirs(f"{root}/log/{s}")
                                       if b.startswith("batch_id="))
            for s in dirs(f"{root}/log") if s.startswith("source=")}


# --- reads -------------------------------------------------------------------

def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One scan of a folder; a folder that is not there is an empty frame (only
    the path-not-found condition is swallowed)."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_store_log(spark: SparkSession, root: str) -> DataFrame:
    """The unresolved store: every batch of every lineage, in one scan."""
    return _read(spark, f"{root}/log", STORED_SCHEMA).select(*_STORED_COLS)


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """Identities per batch, date and severity."""
    return _read(spark, f"{root}/counts", COUNTS_SCHEMA)


def batches_since(counts: DataFrame, bound) -> DataFrame:
    """``source, batch_id`` of the batches that hold rows of ``bound`` (a date
    column) or later.

    A semi-join of the log with it prunes batch folders while the query runs:
    they are partitions of the log.  Spark does so if this frame is small
    enough for its own broadcast limit, and reads all folders beyond it."""
    return counts.where(F.col("event_date") >= bound).select("source", "batch_id").distinct()


def write_counters(counters: DataFrame, root: str, source: str, batch_id: int) -> None:
    """One row of counters beside a batch (A3); a batch that runs again replaces its own."""
    counters.coalesce(1).write.mode("overwrite").parquet(batch_path(root, source, batch_id, "counters"))


def read_counters(spark: SparkSession, root: str) -> DataFrame:
    """``processed, errors, malformed`` per batch, of every lineage since the store began."""
    return _read(spark, f"{root}/counters", COUNTERS_SCHEMA)


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The store as readers see it: latest write per identity.

    Filters on severity and event_date (both functions of the identity) go
    below latest-wins and into the scan.
    """
    return latest_wins(read_store_log(spark, root))
