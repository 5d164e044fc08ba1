"""Streaming ingest: source → decode → process → store + dead letters.

At-least-once, like the writer it replaces: a micro-batch's offsets are
committed only after ``foreachBatch`` returns, i.e. after both writes are
done.  A batch that runs again (executor loss, restart) overwrites its own
``batch_id`` directories, and latest-wins on read makes redelivered events
add nothing.  Every checkpoint is a lineage of its own in the store, so several
ingest queries, or one with a new checkpoint, add to one store.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.redact import redact
from ..operators.process import SANITIZE_FIRST, STORED, VALIDATE_FIRST, process, route
from ..operators.report import ingest_counter_columns, ingest_counters
from ..schema import ARRIVAL_ORDER, DEADLETTER_SCHEMA, IDENTITY
from ..sources.codec import decode_events, encode_events
from ..sources.store import (REPLAY, STREAM, arrival_time, batch_path, claim_batch, drop_note, read_note,
                             to_store_rows, write_counters, write_note, write_store)

DELIVERIES = 5               # a batch that failed so often goes to the dead letters
UNDELIVERED = "undelivered"  # disposition and error code of its valid rows
MAX_DELIVER = "max_deliver"


def read_event_stream(spark: SparkSession, fmt: str = "text", path: str | None = None,
                      **options) -> DataFrame:
    """A streaming frame with the wire text in ``value`` and ``ingest_seq``.

    ``fmt="kafka"``: pass ``kafka.bootstrap.servers`` and ``subscribe`` as
    options; ``ingest_seq`` is built from partition and offset, and scale-out
    follows the topic's partitions (``minPartitions`` to split further).
    ``fmt="text"``: one payload per line in files under ``path``; size each
    micro-batch with ``maxFilesPerTrigger``.
    """
    reader = spark.readStream.format(fmt)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(path) if path is not None else reader.load()
    if fmt == "kafka":
        return df.select(F.col("value").cast("string").alias("value"),
                         (F.col("partition").cast("bigint") * F.lit(1 << 40)
                          + F.col("offset")).alias("ingest_seq"))
    return df.select(F.col("value").cast("string").alias("value"))


def write_event_stream(df: DataFrame, fmt: str = "text", path: str | None = None,
                       checkpoint: str | None = None, trigger: dict | None = None,
                       **options) -> StreamingQuery:
    """Publish events as wire JSON (S4).  Kafka retries sends itself; the text
    sink is for tests and files."""
    out = encode_events(df).select("value")
    w = out.writeStream.format(fmt)
    if trigger:
        w = w.trigger(**trigger)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    for k, v in options.items():
        w = w.option(k, v)
    return w.start(path) if path is not None else w.start()


def dead_letter_rows(rejected: DataFrame, source: str, batch_id: int,
                     ingest_ts: _dt.datetime, redact_raw: bool = False, attempts: int = 1) -> DataFrame:
    """Rejected rows → ``DEADLETTER_SCHEMA`` (G4).  ``raw`` is kept for replay;
    ``redact_raw`` masks credentials in every text column and marks the rows,
    which are then no longer replayed (their text is not what was sent).
    ``attempts`` is how often their batch was delivered."""
    ts_text = ingest_ts.astimezone(_dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")

    def text(name: str):
        return (redact(F.col(name)) if redact_raw else F.col(name)).alias(name)

    return rejected.select(
        text("raw"), F.col("criticality").cast("bigint").alias("criticality"),
        text("timestamp"), text("event_message"), F.col("disposition"),
        F.col("error_codes"), text("error"), F.lit(redact_raw).alias("redacted"),
        F.lit(attempts).cast("bigint").alias("attempts"),
        F.lit(ts_text).cast("timestamp").alias("ingest_ts"),
        F.lit(source).alias("source"), F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.col("ingest_seq").cast("bigint").alias("ingest_seq"))


def write_dead_letters(rows: DataFrame, root: str, source: str, batch_id: int) -> None:
    (rows.drop("source", "batch_id").hint("rebalance").write.mode("overwrite")
     .parquet(batch_path(root, source, batch_id, area="deadletter")))


def write_batch(processed: DataFrame, root: str, source: str, batch_id: int,
                redact_raw: bool = False, letters: bool = True, attempts: int = 1) -> None:
    """The writes of one processed batch, keyed by ``batch_id`` (G2, S5, G4), and
    its counters (A3).

    The batch is persisted so its input is read once for the writes; a
    lost cached block is recomputed from the (replayable) source.
    """
    ingest_ts = arrival_time(processed.sparkSession, root)
    processed = _with_position(processed).persist()
    try:
        stored, rejected = route(processed)
        write_store(to_store_rows(stored, source, batch_id, ingest_ts), root, source, batch_id)
        if letters:
            write_dead_letters(dead_letter_rows(rejected, source, batch_id, ingest_ts, redact_raw, attempts),
                               root, source, batch_id)
            write_counters(ingest_counters(processed), root, source, batch_id)
    finally:
        processed.unpersist()


def _with_position(processed: DataFrame) -> DataFrame:
    """``ingest_seq`` as the position inside the micro-batch where the input has
    none; stable when the batch is run again on the same input files / offsets."""
    if "ingest_seq" in processed.columns:
        return processed
    return processed.withColumn("ingest_seq", F.monotonically_increasing_id())


def give_up_batch(processed: DataFrame, root: str, source: str, batch_id: int, attempts: int,
                  redact_raw: bool = False) -> None:
    """A batch that could not be written ``attempts`` times goes to the dead
    letters whole (G6); rows that were valid as ``undelivered``, to be replayed."""
    spark = processed.sparkSession
    rows = _with_position(processed)
    valid = F.col("disposition") == STORED
    rows = rows.withColumns({
        "error_codes": F.when(valid, F.array(F.lit(MAX_DELIVER))).otherwise(F.col("error_codes")),
        "error": F.when(valid, F.lit(f"not written in {attempts} attempts")).otherwise(F.col("error")),
        "disposition": F.when(valid, F.lit(UNDELIVERED)).otherwise(F.col("disposition"))})
    write_dead_letters(dead_letter_rows(rows, source, batch_id, arrival_time(spark, root), redact_raw, attempts),
                       root, source, batch_id)


def lineage(spark: SparkSession, checkpoint: str) -> str:
    """The store's name for a checkpoint: made once, kept inside the checkpoint,
    so a checkpoint that is thrown away and made again is another lineage."""
    path = f"{checkpoint}/_lineage"
    name = read_note(spark, path)
    if name is None:
        name = f"{STREAM}-{uuid.uuid4().hex[:12]}"
        write_note(spark, path, name)
    return name


def run_ingest(spark: SparkSession, stream: DataFrame, root: str, checkpoint: str,
               order: str = VALIDATE_FIRST, trigger: dict | None = None,
               redact_raw: bool = False, query_name: str | None = None,
               max_deliver: int = DELIVERIES) -> StreamingQuery:
    """Start the ingest stream.

    ``stream`` carries the wire text in ``value``.  ``trigger`` is passed to
    ``DataStreamWriter.trigger`` (default ``processingTime='10 seconds'``;
    ``{"availableNow": True}`` drains what is there and stops).  Counters
    (A3) are reported under ``ingest`` in ``lastProgress.observedMetrics``.

    A batch whose write fails stops the query; started again from its
    checkpoint it runs again.  The checkpoint keeps the number of attempts per
    batch: after ``max_deliver`` failures the batch goes to the dead letters
    and the stream goes on (G6).
    """
    source = lineage(spark, checkpoint)
    processed = process(decode_events(stream), order)
    processed = processed.observe("ingest", *ingest_counter_columns())

    def _batch(df: DataFrame, batch_id: int) -> None:
        ledger = f"{checkpoint}/_attempts-{batch_id}"
        failed = int(read_note(spark, ledger) or 0)
        if failed >= max_deliver:
            give_up_batch(df, root, source, batch_id, failed, redact_raw)
        else:
            write_note(spark, ledger, str(failed + 1))  # counts as failed until it is written
            write_batch(df, root, source, batch_id, redact_raw, attempts=failed + 1)
        drop_note(spark, ledger)

    w = (processed.writeStream.foreachBatch(_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"processingTime": "10 seconds"})))
    if query_name:
        w = w.queryName(query_name)
    return w.start()


def read_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """All dead letters (G4); none yet is an empty frame, not an error."""
    path = f"{root}/deadletter"
    try:
        return spark.read.schema(DEADLETTER_SCHEMA).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], DEADLETTER_SCHEMA)
        raise


REPLAYED_SCHEMA = "rule string, source string, letters_batch long, batch_id long"


def _replays(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(REPLAYED_SCHEMA).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], REPLAYED_SCHEMA)
        raise


def replay(spark: SparkSession, root: str, order: str = SANITIZE_FIRST,
           batch_id: int | None = None, where=None, rule: str | None = None) -> int:
    """Run dead letters through the ingest path again, as a batch job.

    For instance after a rule change (``order="sanitize_first"`` admits
    criticality 0 and 11).  Rows are decoded again from ``raw``; masked rows
    are left out.  A letter stays in its table as it was written, and what a
    replay rejects again is not written a second time.

    ``rule`` names what is applied (default: the order, and ``where``).  Each
    replay takes the letter batches that no finished replay under the same
    rule has taken, so without new letters it writes nothing.  It has its own
    ``batch_id`` under ``source=replay``, which no other replay gets; given one,
    it runs that replay's letters again and overwrites it.  Latest-wins makes
    all of this idempotent.  Returns the batch id.
    """
    rule = rule or (order if where is None else f"{order} where {where}")
    if batch_id is None:
        batch_id = claim_batch(spark, root, REPLAY)
    letters = read_dead_letters(spark, root).where(~F.col("redacted"))
    if where is not None:
        letters = letters.where(where)
    todo, done = f"{root}/replay_todo", f"{root}/replayed"
    if _replays(spark, todo).where(F.col("batch_id") == batch_id).isEmpty():
        finished = _replays(spark, done).where(F.col("rule") == rule).select("source", "letters_batch").distinct()
        (letters.select("source", F.col("batch_id").alias("letters_batch")).distinct()
         .join(finished, ["source", "letters_batch"], "left_anti").select(F.lit(rule).alias("rule"), "source", "letters_batch")
         .write.mode("overwrite").parquet(f"{todo}/batch_id={batch_id}"))
    mine = _replays(spark, todo).where(F.col("batch_id") == batch_id)
    if mine.isEmpty():
        return batch_id
    taken = mine.select("source", F.col("letters_batch").alias("batch_id"))
    letters = letters.join(taken, ["source", "batch_id"], "left_semi")
    decoded = decode_events(letters.select(F.col("raw").alias("value"), "ingest_seq"))
    write_batch(process(decoded, order), root, REPLAY, batch_id, letters=False)
    mine.drop("batch_id").write.mode("overwrite").parquet(f"{done}/batch_id={batch_id}")
    return batch_id


def latest_stream(df: DataFrame, delay: str = "10 minutes", identity=IDENTITY, order=None) -> DataFrame:
    """The last copy of every identity on a stream (G8 with the rule of U1).

    The greatest by arrival order is an aggregate, so each map task sends one
    row per identity and the state holds one, however many copies an identity
    has.  Run it in ``update`` mode: a micro-batch gives the identities whose
    last copy may have changed, and the row of the latest batch counts.  The
    state of an identity goes once its time is older than the watermark;
    copies that come later than that are dropped.
    """
    order = list(order or [c for c in ARRIVAL_ORDER if c in df.columns])
    rest = [c for c in df.columns if c not in order and c not in identity]
    last = F.max(F.struct(*order, *rest)).alias("last")
    return (df.withWatermark("time", delay).groupBy(*identity).agg(last)
            .select(*[c if c in identity else F.col(f"last.{c}").alias(c) for c in df.columns]))


def dedup_stream(df: DataFrame, delay: str = "10 minutes",
                 identity=IDENTITY) -> DataFrame:
    """Drop redelivered copies inside a watermark (G8, optional).

    First copy wins and rows later than the watermark are dropped, first
    copies too, so this only suits pure redelivery; latest-wins stays the
    default resolution.  All copies of one identity meet in one state
    partition, which a stream cannot split.
    """
    return df.withWatermark("time", delay).dropDuplicatesWithinWatermark(list(identity))
