"""Registered queries: one per operator of the inventory, over the whole tables.

Each takes ``(spark, sf_dir)`` and returns a DataFrame whose columns match
its DuckDB twin in ``plans/oracle.py`` by name and type (BIGINT, VARCHAR,
BOOLEAN, TIMESTAMP without zone).  Times leave as ``timestamp_ntz`` in UTC.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (clamp_criticality, color_band, parse_event_time, redact,
                         redact_columns, sanitize_message, severity)
from ..operators.process import PROCESSED_COLS, SANITIZE_FIRST, process, route
from ..operators.query import (count_events, query_events, query_events_sql,
                               latest_store_events, query_store_newest_first,
                               response_envelope, response_json, result_columns,
                               severity_events)
from ..operators.report import (error_summary, heatmap_matrix, heatmap_rows, ingest_counters,
                                missing_from_store)
from ..operators.upsert import latest_wins
from ..operators.validate import request_arguments
from ..session import new_work_dir
from ..sources.codec import decode_events, encode_events
from ..sources.store import read_counters, read_counts, read_store, read_store_log
from ..streaming.ingest import (dedup_stream, latest_stream, read_dead_letters, read_event_stream, replay,
                                run_ingest, write_event_stream)
from ..streaming.monitor import milestone
from . import fixtures as fx
from . import stores

SINCE_NS = "2024-01-25T12:00:00.000000500Z"

Query = Callable[[SparkSession, str], DataFrame]


def _ntz(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz")


def _store_cols(df: DataFrame) -> DataFrame:
    return df.select(_ntz("time").alias("time"),
                     F.col("time_ns_rem").cast("bigint").alias("time_ns_rem"),
                     "severity", "criticality", "event_message")


def _result_ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({"timestamp": _ntz("timestamp"),
                           "time_ns_rem": F.col("time_ns_rem").cast("bigint")})


def _sec_store(spark, sf):
    """B1 as the reader sees it: the stored table, latest write per identity."""
    return read_store(spark, stores.sec_store(spark, sf))


def _redelivered_store(spark, sf):
    """B2 as the reader sees it (three batches, resolved)."""
    return read_store(spark, stores.redelivered_store(spark, sf))


def _payload_processed(spark, sf, columns=PROCESSED_COLS):
    return process(decode_events(fx.sec_payload(spark, sf)), columns=columns)


# --- reader queries -------------------------------------------------------

def reader_query(spark, sf):
    """G1 + U1 + T1: ``criticality >= 5 ORDER BY time DESC LIMIT 10`` — the flagship,
    over the newest dates of the stored table."""
    return _result_ntz(query_store_newest_first(spark, stores.sec_store(spark, sf), 5, 10))


def reader_query_wide(spark, sf):
    """T1 with ``criticality >= 9 LIMIT 100``: the newest day is not enough, so the
    date bound lies further back."""
    return _result_ntz(query_store_newest_first(spark, stores.sec_store(spark, sf), 9, 100))


def reader_query_sql(spark, sf):
    """T1 as SQL text with bound parameters over the resolved store as a view."""
    root = stores.sec_store(spark, sf)
    read_store(spark, root).createOrReplaceTempView("alertflow_store_resolved")
    read_counts(spark, root).createOrReplaceTempView("alertflow_store_counts")
    return _result_ntz(query_events_sql(spark, "alertflow_store_resolved", "alertflow_store_counts", 5, 10))


def reader_query_stale(spark, sf):
    """T1 over the redelivered store with a minimum of 8: stale copies lower some
    rows to 7, and those must not come back."""
    return _result_ntz(query_store_newest_first(spark, stores.redelivered_store(spark, sf), 8, 100))


def reader_query_ns(spark, sf):
    """T1 where many events share a microsecond: order and result to the nanosecond."""
    return _result_ntz(query_store_newest_first(spark, stores.ns_store(spark, sf), 5, 100))


def since_ns(spark, sf):
    """P3 with a bound inside one microsecond."""
    return _result_ntz(query_store_newest_first(spark, stores.ns_store(spark, sf), 9, 1000,
                                                since=SINCE_NS))


def null_fields(spark, sf):
    """F5 + F6: missing criticality and message read as 0 and ''."""
    rows = fx.store_rows(fx.sec(spark, sf)).withColumns({
        "criticality": F.when(F.col("ingest_seq") % 5 != 0, F.col("criticality")),
        "event_message": F.when(F.col("ingest_seq") % 7 != 0, F.col("event_message"))})
    return _result_ntz(result_columns(rows))


def reader_query_unstored(spark, sf):
    """G1 + U1 + T1 straight from ``events``: validate, clean, classify and
    resolve in one plan (no stored table)."""
    return _result_ntz(query_events(fx.store_rows(fx.sec(spark, sf)), 5, 10))


def since_events(spark, sf):
    """P3 + T1: strictly after 2024-01-15, criticality >= 5, limit 100."""
    return _result_ntz(query_store_newest_first(spark, stores.sec_store(spark, sf), 5, 100,
                                                since="2024-01-15T00:00:00Z"))


def latest_events_q(spark, sf):
    """T2 over the redelivered store: newest 10 after latest-wins, newest
    date partitions first."""
    return _store_cols(latest_store_events(spark, stores.redelivered_store(spark, sf), 10))


def critical_events(spark, sf):
    """Severity 'critical', newest first, no limit."""
    return _store_cols(severity_events(_redelivered_store(spark, sf), "critical", resolve=False))


def count_events_q(spark, sf):
    """U1 + A1: identities of the store (a hash aggregate over the log's identity columns)."""
    return count_events(read_store_log(spark, stores.redelivered_store(spark, sf)))


def latest_wins_q(spark, sf):
    """One row per identity, the last arrival."""
    return _store_cols(_redelivered_store(spark, sf))


def latest_wins_unstored(spark, sf):
    """U1 on the redelivered frame in one plan (window with a group limit)."""
    return _store_cols(latest_wins(fx.store_rows(fx.sec_redelivered(spark, sf))))


def latest_wins_hot_identity(spark, sf):
    """U1 when one identity holds a third of all rows (the skew case): the
    group limit on the map side keeps one row per task before the shuffle."""
    return _store_cols(latest_wins(fx.store_rows(fx.sec_hot(spark, sf))))


def latest_wins_filtered(spark, sf):
    """U1 then ``criticality >= 8`` above it: stale copies must not come back."""
    return _store_cols(_redelivered_store(spark, sf)).where(F.col("criticality") >= 8)


def response_total(spark, sf):
    """S8 + A2: envelope of the flagship result; total = rows returned."""
    env = response_envelope(query_store_newest_first(spark, stores.sec_store(spark, sf), 5, 10))
    return env.select(F.col("total"),
                      F.col("events")[0]["criticality"].alias("first_criticality"),
                      _ntz(F.element_at("events", -1)["timestamp"]).alias("last_timestamp"))


def response_document(spark, sf):
    """S8 on the wire: ``{"events":[...],"total":n}`` for the flagship query,
    times in RFC 3339 UTC, newest first."""
    env = response_envelope(query_store_newest_first(spark, stores.sec_store(spark, sf), 5, 10))
    return response_json(env)


def response_document_ns(spark, sf):
    """S8 on the wire where the newest events share a microsecond."""
    env = response_envelope(query_store_newest_first(spark, stores.ns_store(spark, sf), 5, 10))
    return response_json(env)


# --- codec ----------------------------------------------------------------

def encoded_events(spark, sf):
    """S3: events as wire JSON."""
    return (encode_events(fx.sec(spark, sf), time_col="ts", ns_col=None)
            .select("event_id", "value"))


def decode_roundtrip(spark, sf):
    """S3 then S2: every field comes back."""
    enc = encode_events(fx.sec(spark, sf), time_col="ts", ns_col=None)
    return decode_events(enc).select("event_id", "criticality", "timestamp",
                                     "event_message", "malformed")


def event_times(spark, sf):
    """RFC 3339 text (offsets, 9 and 12 fraction digits) → UTC instant + sub-µs."""
    t = fx.sec_times(spark, sf)
    p = parse_event_time(F.col("timestamp"))
    return t.select("event_id", _ntz(p["time"]).alias("time"),
                    p["time_ns_rem"].cast("bigint").alias("time_ns_rem"))


# --- validation and processing ---------------------------------------------

def decode_dispositions(spark, sf):
    """S2 + V1 + G2: rows per disposition over the broken-payload table."""
    return (_payload_processed(spark, sf, ["disposition"]).groupBy("disposition")
            .agg(F.count(F.lit(1)).alias("n")))


def validation_errors(spark, sf):
    """V1 + A6: failures by code (a row failing several checks counts under each)."""
    _, rejected = route(_payload_processed(spark, sf, ["disposition", "error_codes"]))
    return error_summary(rejected)


def dead_letters(spark, sf):
    """G2 + G4: rejected rows with their codes."""
    _, rejected = route(_payload_processed(spark, sf))
    return rejected.select("event_id", "disposition",
                           F.array_join("error_codes", ",").alias("error_codes"),
                           "criticality")


def ingest_counters_q(spark, sf):
    """A3: processed / errors / malformed."""
    return ingest_counters(_payload_processed(spark, sf, ["disposition"]))


def sanitized_messages(spark, sf):
    """F1 on messages full of Unicode blanks and look-alikes."""
    d = fx.sec_dirty(spark, sf)
    return d.select("event_id", sanitize_message("event_message").alias("event_message"))


def classified(spark, sf):
    """F2 + F3 + F8 on the raw criticality (including out-of-range values)."""
    s = fx.sec(spark, sf)
    return s.select("event_id", "criticality",
                    clamp_criticality("criticality").alias("clamped"),
                    severity("criticality").alias("severity"),
                    color_band("criticality").alias("band"))


def sanitize_first(spark, sf):
    """G1 in the documented order: clean and clamp, then check."""
    p = process(fx.as_decoded(fx.sec(spark, sf)), SANITIZE_FIRST)
    return p.select("event_id", "disposition", "criticality", "severity", "event_message")


def request_checks(spark, sf):
    """V2 + V3: the argument checks over a table of requests."""
    return fx.requests(spark, sf).select("event_id", request_arguments().alias("r")).select("event_id", "r.*")


# --- reports ---------------------------------------------------------------

def severity_rollup_q(spark, sf):
    """F3 + A5: count, first and last time per severity."""
    from ..operators.report import severity_rollup
    r = severity_rollup(_sec_store(spark, sf))
    return r.select("severity", "n", _ntz("first_time").alias("first_time"),
                    _ntz("last_time").alias("last_time"))


def heatmap_rows_q(spark, sf):
    """H1 + F7 + F8: one display row per stored event (whole table)."""
    rows = read_store(spark, stores.props_store(spark, sf)).select(
        F.col("time").alias("timestamp"), "criticality", "event_message")
    return heatmap_rows(rows)


def heatmap_matrix_q(spark, sf):
    """H2: message × criticality counts."""
    return heatmap_matrix(_sec_store(spark, sf))


def heatmap_matrix_daily(spark, sf):
    """H2 with a daily time bucket."""
    m = heatmap_matrix(_sec_store(spark, sf), bucket="day")
    return m.withColumn("bucket_start", _ntz("bucket_start"))


def redacted(spark, sf):
    """truncation + five masking rules."""
    s = fx.sec_secret(spark, sf)
    return s.select("event_id", redact("s").alias("s"))


def redacted_columns(spark, sf):
    """F10 + F11: every string column masked, NULL read as ''."""
    s = fx.sec_secret(spark, sf).withColumn(
        "t", F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string"))
              .otherwise(F.concat(F.lit("pwd="), F.col("event_id").cast("string"))))
    return redact_columns(s, null_as_empty=True)


def missing_from_store_q(spark, sf):
    """Events of the source (B1, stored) whose identity never reached the
    store written from their wire payloads (B3)."""
    source = read_store(spark, stores.sec_store(spark, sf))
    store = read_store(spark, stores.payload_store(spark, sf))
    return _store_cols(missing_from_store(source, store))


def missing_from_store_prefiltered(spark, sf):
    """J1 with the bitmap of the source's identities tested in the store's scan:
    what the payload store lacks of the events, as ``missing_from_store``."""
    source = read_store(spark, stores.sec_store(spark, sf))
    store = read_store_log(spark, stores.payload_store(spark, sf))
    return _store_cols(missing_from_store(source, store, prefilter_bits=2 ** 26))


def heatmap_reader(spark, sf):
    """H1 on the reader's result (what the terminal client draws): the
    flagship query's rows with their level marks and band."""
    rows = query_store_newest_first(spark, stores.sec_store(spark, sf), 5, 10)
    return heatmap_rows(rows)


# --- streaming -------------------------------------------------------------

STREAM_FILES = 16


def _write_payload_files(spark, sf, path: str) -> None:
    """The payloads as text files, one payload per line."""
    (fx.sec_payload(spark, sf).select("value")
     .repartition(STREAM_FILES).write.mode("overwrite").text(path))


def _ingest(spark, work: str, root: str | None = None, checkpoint: str = "checkpoint") -> str:
    """Run the ingest over the text files under ``work`` until they are read."""
    stream = read_event_stream(spark, "text", f"{work}/in", maxFilesPerTrigger=STREAM_FILES // 2)
    root = root or f"{work}/store"
    run_ingest(spark, stream, root, f"{work}/{checkpoint}", trigger={"availableNow": True}).awaitTermination()
    return root


def ingest_stream(spark, sf):
    """JSON text files → stream (availableNow, twice) → store; read resolved."""
    work = new_work_dir(spark, "ingest")
    _write_payload_files(spark, sf, f"{work}/in")
    _ingest(spark, work)
    return _store_cols(read_store(spark, _ingest(spark, work)))  # the same checkpoint adds nothing


def ingest_new_checkpoint(spark, sf):
    """G3 + S6: a second ingest of the same files from a new checkpoint (batch
    numbers start again) adds a lineage; the resolved store is the same."""
    work = new_work_dir(spark, "lineages")
    _write_payload_files(spark, sf, f"{work}/in")
    _ingest(spark, work)
    return _store_cols(read_store(spark, _ingest(spark, work, checkpoint="checkpoint-2")))


def ingest_two_writers(spark, sf):
    """S5 + G3: two ingests of the two halves of the files, at once, into one store."""
    work = new_work_dir(spark, "writers")
    payloads = fx.sec_payload(spark, sf).select("value")
    halves = payloads.withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2)))
    halves.repartition(STREAM_FILES).write.partitionBy("half").text(f"{work}/in")
    root = f"{work}/store"
    queries = [run_ingest(spark, read_event_stream(spark, "text", f"{work}/in/half={h}",
                                                   maxFilesPerTrigger=STREAM_FILES // 2),
                          root, f"{work}/checkpoint-{h}", trigger={"availableNow": True}) for h in (0, 1)]
    for q in queries:
        q.awaitTermination()
    return _store_cols(read_store(spark, root))


def ingest_milestone(spark, sf):
    """A3 + A4: counters kept beside the batches, summed over an ingest in two runs."""
    work = new_work_dir(spark, "milestone")
    _write_payload_files(spark, sf, f"{work}/in")
    _ingest(spark, work)
    return milestone(read_counters(spark, _ingest(spark, work)))


def replay_dead_letters(spark, sf):
    """Ingest, then replay the dead letters with the documented order
    (running the same replay batch again adds nothing: tests/test_streaming.py)."""
    work = new_work_dir(spark, "replay")
    _write_payload_files(spark, sf, f"{work}/in")
    root = _ingest(spark, work)
    replay(spark, root, order=SANITIZE_FIRST, batch_id=0)
    return _store_cols(read_store(spark, root))


def dead_letters_stored(spark, sf):
    """The dead-letter table as written by the ingest, read back after two
    replays (which add no letters)."""
    work = new_work_dir(spark, "letters")
    _write_payload_files(spark, sf, f"{work}/in")
    root = _ingest(spark, work)
    for _ in range(2):
        replay(spark, root, order=SANITIZE_FIRST)
    return read_dead_letters(spark, root).select(
        "disposition", F.array_join("error_codes", ",").alias("error_codes"), "criticality")


def published_events(spark, sf):
    """Stored events published as wire JSON to text files by a stream, decoded again."""
    work = new_work_dir(spark, "publish")
    rows = fx.store_rows(fx.sec(spark, sf))
    rows.write.parquet(f"{work}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{work}/in")
    q = write_event_stream(stream, "text", f"{work}/out", f"{work}/checkpoint",
                           trigger={"availableNow": True})
    q.awaitTermination()
    return decode_events(spark.read.text(f"{work}/out")).select(
        "criticality", "timestamp", "event_message", "malformed")


DEDUP_SLICE_DAYS = 10


def dedup_stream_q(spark, sf):
    """Redelivered and stale copies dropped inside a watermark (first copy wins).

    The originals come in slices of ten days, a micro-batch each; copies come one
    slice later than their originals, inside the watermark.
    """
    work = new_work_dir(spark, "dedup")
    rows = fx.store_rows(fx.sec_redelivered(spark, sf))
    day = F.datediff("event_date", F.lit(fx.FIRST_DAY).cast("date"))
    copies = F.when(F.col("ingest_seq") >= fx.REDELIVER_SEQ, 1).otherwise(0)
    rows = rows.withColumn("slice", F.floor(day / DEDUP_SLICE_DAYS) + copies)
    rows.write.partitionBy("slice").parquet(f"{work}/slices")  # once, in as many tasks as the rows ask for
    schema = rows.drop("slice").schema
    slices = spark.read.schema(rows.schema).parquet(f"{work}/slices")
    for n in sorted(r[0] for r in slices.select("slice").distinct().collect()):
        # the stream goes on from its checkpoint with the files of one more slice
        slices.where(F.col("slice") == n).drop("slice").write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(schema).parquet(f"{work}/in")
        (dedup_stream(stream, f"{2 * DEDUP_SLICE_DAYS + 5} days").select("severity", "time", "time_ns_rem")
         .writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start(f"{work}/out").awaitTermination())
    out = spark.read.schema("severity string, time timestamp, time_ns_rem smallint") \
        .parquet(f"{work}/out")
    return out.select("severity", _ntz("time").alias("time"),
                      F.col("time_ns_rem").cast("bigint").alias("time_ns_rem"))


LATEST_DELAY = "3660 days"   # the files come in no order of time


def latest_stream_hot_identity(spark, sf):
    """G8 with the rule of U1, a third of all rows on one identity: two micro-batches
    of files whose copies are in no order; the latest batch's row of an identity counts."""
    work = new_work_dir(spark, "latest")
    rows = fx.store_rows(fx.sec_hot(spark, sf)).drop("event_date")
    rows.repartition(STREAM_FILES).write.parquet(f"{work}/in")
    stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", STREAM_FILES // 2)
              .parquet(f"{work}/in"))

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{work}/out/n={batch_id}")

    (latest_stream(stream, LATEST_DELAY).writeStream.outputMode("update").foreachBatch(write)
     .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    out = spark.read.schema(rows.schema.add("n", "long")).parquet(f"{work}/out")
    return _store_cols(latest_wins(out, order=["n"]))


QUERIES: dict[str, Query] = {
    "reader_query": reader_query,
    "reader_query_wide": reader_query_wide,
    "reader_query_sql": reader_query_sql,
    "reader_query_unstored": reader_query_unstored,
    "reader_query_stale": reader_query_stale,
    "reader_query_ns": reader_query_ns,
    "since_events": since_events,
    "since_ns": since_ns,
    "null_fields": null_fields,
    "latest_events": latest_events_q,
    "critical_events": critical_events,
    "count_events": count_events_q,
    "latest_wins": latest_wins_q,
    "latest_wins_unstored": latest_wins_unstored,
    "latest_wins_filtered": latest_wins_filtered,
    "latest_wins_hot_identity": latest_wins_hot_identity,
    "response_total": response_total,
    "response_document": response_document,
    "response_document_ns": response_document_ns,
    "encoded_events": encoded_events,
    "decode_roundtrip": decode_roundtrip,
    "event_times": event_times,
    "decode_dispositions": decode_dispositions,
    "validation_errors": validation_errors,
    "dead_letters": dead_letters,
    "ingest_counters": ingest_counters_q,
    "sanitized_messages": sanitized_messages,
    "classified": classified,
    "sanitize_first": sanitize_first,
    "severity_rollup": severity_rollup_q,
    "heatmap_rows": heatmap_rows_q,
    "heatmap_reader": heatmap_reader,
    "heatmap_matrix": heatmap_matrix_q,
    "heatmap_matrix_daily": heatmap_matrix_daily,
    "redacted": redacted,
    "redacted_columns": redacted_columns,
    "missing_from_store": missing_from_store_q,
    "missing_from_store_prefiltered": missing_from_store_prefiltered,
    "ingest_stream": ingest_stream,
    "ingest_new_checkpoint": ingest_new_checkpoint,
    "ingest_two_writers": ingest_two_writers,
    "ingest_milestone": ingest_milestone,
    "published_events": published_events,
    "dead_letters_stored": dead_letters_stored,
    "replay_dead_letters": replay_dead_letters,
    "dedup_stream": dedup_stream_q,
    "latest_stream_hot_identity": latest_stream_hot_identity,
    "request_checks": request_checks,
}
