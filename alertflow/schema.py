"""Fixed schemas.  Nothing in this package infers a schema."""

from pyspark.sql import types as T

# The three keys of a wire event, in the order they are written.
WIRE_KEYS = ("criticality", "timestamp", "eventMessage")

DECODED_SCHEMA = T.StructType([
    T.StructField("raw", T.StringType()),
    T.StructField("criticality", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_message", T.StringType()),
    T.StructField("malformed", T.BooleanType()),
    T.StructField("ingest_seq", T.LongType()),
])

STORED_SCHEMA = T.StructType([
    T.StructField("time", T.TimestampType()),
    T.StructField("time_ns_rem", T.ShortType()),
    T.StructField("criticality", T.LongType()),
    T.StructField("event_message", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("ingest_ts", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("ingest_seq", T.LongType()),
])

RESULT_SCHEMA = T.StructType([
    T.StructField("criticality", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("time_ns_rem", T.ShortType()),
    T.StructField("event_message", T.StringType()),
])

DEADLETTER_SCHEMA = T.StructType([
    T.StructField("raw", T.StringType()),
    T.StructField("criticality", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_message", T.StringType()),
    T.StructField("disposition", T.StringType()),
    T.StructField("error_codes", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("redacted", T.BooleanType()),
    T.StructField("attempts", T.LongType()),
    T.StructField("ingest_ts", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("ingest_seq", T.LongType()),
])

# Row identity in the store: the same identity written again replaces the row.
IDENTITY = ("severity", "time", "time_ns_rem")

# Arrival order; the greatest wins.  ``ingest_ts`` never goes back inside a
# store (sources/store.py), so a clock set back cannot reorder batches.  The
# last two only break exact ties.
ARRIVAL_ORDER = ("ingest_ts", "source", "batch_id", "ingest_seq",
                 "criticality", "event_message")
