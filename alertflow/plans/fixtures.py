"""Frames derived from the driver's ``events`` table (FIXTURES.md §B).

The ``events`` table has unique timestamps and clean text, so duplicates,
dirty blanks, broken payloads and secrets are built into these frames from
every row of it; nothing here samples or caps the input.  Each frame has a
twin in ``plans/oracle.py`` written as DuckDB SQL.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefmt import format_event_time
from ..operators.process import STORED, process
from ..sources.codec import encode_events
from ..sources.store import STREAM, to_store_rows

# Fixed fixture parameters (shared with the SQL twins).
REDELIVER_MOD = 10          # every 10th event is delivered twice
REDELIVER_SEQ = 1_000_000_000
STALE_MOD = 15              # every 15th event with criticality 8 or 10 ...
STALE_SEQ = 2_000_000_000   # ... gets a later copy with criticality - 1
PAYLOAD_MOD = 97            # payload corruption class
SECRET_MOD = 8              # redaction input class
NS_MOD = 1000               # nanosecond digits of the equal-microsecond fixture
WIDE_MOD = 5                # every fifth display message starts with ...
WIDE_CHARS = 20             # ... one letter and this many two-byte ones
TIME_MOD = 5                # timestamp text class
# Code points placed around message words: white space (collapsed) and
# look-alikes that are not white space (kept).
BLANK_CODEPOINTS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, 0x2000,
                    0x2005, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
                    0x200B, 0xFEFF, 0x180E, 0x1C)
FIRST_DAY = "2024-01-01"    # first event date of the input table
FIXED_INGEST_TS = _dt.datetime(2026, 1, 1, tzinfo=_dt.timezone.utc)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, as Spark reads it (``spark.sql.files.maxPartitionBytes``
    sets the split size)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def criticality_of(value: Column) -> Column:
    return F.floor(value / 20).cast("bigint")


def sec(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """B1: ``event_id, ts, seq, criticality, event_message`` from ``events``
    (plus the ``extra`` columns of ``events`` asked for)."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", *extra, F.col("event_id").alias("seq"),
        criticality_of(F.col("value")).alias("criticality"),
        F.concat(F.lit("  "), F.col("event_type"), F.lit("   by user "),
                 F.col("user_id").cast("string"), F.lit(" ")).alias("event_message"))


def ns_time() -> Column:
    """A wire time that puts all events of an hour into one microsecond, apart
    by nanoseconds."""
    return F.concat(F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss"),
                    F.lit(".000000"), F.lpad((F.col("event_id") % NS_MOD).cast("string"), 3, "0"),
                    F.lit("Z"))


def as_decoded(df: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """B1 as a decoded wire event: the time as RFC 3339 text, seq as arrival."""
    return df.withColumns({"timestamp": format_event_time(F.col("ts")) if timestamp is None else timestamp,
                           "ingest_seq": F.col("seq"),
                           "malformed": F.lit(False)})


def sec_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: B1 plus redelivered copies and stale copies with a lower criticality."""
    s = sec(spark, sf_dir)
    again = (s.where(F.col("event_id") % REDELIVER_MOD == 0)
             .withColumns({"seq": F.col("seq") + REDELIVER_SEQ,
                           "event_message": F.concat(F.col("event_message"), F.lit(" (again)"))}))
    stale = (s.where((F.col("event_id") % STALE_MOD == 0) & F.col("criticality").isin(8, 10))
             .withColumns({"seq": F.col("seq") + STALE_SEQ,
                           "criticality": F.col("criticality") - 1}))
    return s.unionByName(again).unionByName(stale)


HOT_MOD = 3  # every third event is re-stamped onto one identity


def sec_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 where a third of all rows are copies of one identity: every third
    event is re-stamped with the first event time and criticality 9 (so the
    same severity), arriving in ``seq`` order.  The skew case for latest-wins."""
    s = sec(spark, sf_dir)
    first = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    hot = F.col("event_id") % HOT_MOD == 0
    return s.withColumns({"ts": F.when(hot, first).otherwise(F.col("ts")),
                          "criticality": F.when(hot, F.lit(9).cast("bigint"))
                          .otherwise(F.col("criticality"))})


def store_rows(df: DataFrame, order: str = "validate_first", batch_id: int = 0,
               timestamp: Column | None = None) -> DataFrame:
    """Process a B1-shaped frame and keep what would be stored, as store rows."""
    p = process(as_decoded(df, timestamp), order)
    rows = to_store_rows(p.where(F.col("disposition") == STORED), STREAM, batch_id,
                         FIXED_INGEST_TS)
    return rows


def sec_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 as wire JSON, one corruption class per ``event_id % 97``.

    0 cut text, 1 trailing text, 2 criticality as text, 3 timestamp as a
    number, 4 message of blanks only, 5 literal null, 6 timestamp without
    offset, 7 message of 501 'é' (1002 bytes), 8 message of 500 'é' (1000
    bytes), 9 empty message, 10 duplicate criticality key (last wins),
    11 unknown extra key, 12 blanks around the object; others well formed.
    One payload per line (no raw line breaks), so it can travel as text files.
    """
    s = sec(spark, sf_dir)
    k = F.col("event_id") % PAYLOAD_MOD
    ts_text = format_event_time(F.col("ts"))
    msg = (F.when(k == 4, F.lit("    "))
           .when(k == 7, F.repeat(F.lit("é"), 501))
           .when(k == 8, F.repeat(F.lit("é"), 500))
           .when(k == 9, F.lit(""))
           .otherwise(F.col("event_message")))
    ts = F.when(k == 6, F.regexp_replace(ts_text, "Z$", "")).otherwise(ts_text)
    base = encode_events(s.withColumns({"_m": msg, "_t": ts}), message_col="_m",
                         timestamp_text_col="_t", out_col="_json")
    j = F.col("_json")
    value = (F.when(k == 0, F.expr("substring(_json, 1, length(_json) - 7)"))
             .when(k == 1, F.concat(j, F.lit(" trailing")))
             .when(k == 2, F.regexp_replace(j, '^\\{"criticality":(-?[0-9]+)',
                                            '{"criticality":"$1"'))
             .when(k == 3, F.regexp_replace(j, '"timestamp":"[^"]*"',
                                            '"timestamp":' + "1705314600"))
             .when(k == 5, F.lit("null"))
             .when(k == 10, F.concat(F.lit('{"criticality":1,'), F.expr("substring(_json, 2)")))
             .when(k == 11, F.concat(F.lit('{"source":"fixture",'), F.expr("substring(_json, 2)")))
             .when(k == 12, F.concat(F.lit(" \t"), j, F.lit("\t ")))
             .otherwise(j))
    return base.select("event_id", "ts", "seq", "criticality", value.alias("value"),
                       F.col("seq").alias("ingest_seq"))


def sec_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 (+2 classes): text holding credentials, by ``event_id % 8``."""
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id") % SECRET_MOD
    uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    s = (F.when(k == 0, F.concat(F.lit("login password="), uid))
         .when(k == 1, F.concat(F.lit("Authorization: Bearer t"), eid))
         .when(k == 2, F.concat(F.lit("nats://u"), uid, F.lit(":p"), eid, F.lit("@h:4222")))
         .when(k == 3, F.concat(F.lit('api_key="k'), uid, F.lit('"')))
         .when(k == 4, F.concat(F.lit("client_secret: s"), eid, F.lit("&x=1")))
         .when(k == 5, F.col("event_type"))
         .when(k == 6, F.concat(F.repeat(F.lit("é"), 1001), F.lit(" password="), uid))
         .otherwise(F.concat(F.lit("tls://u"), uid, F.lit(":p@h token "), eid)))
    return e.select("event_id", s.alias("s"))


REQUEST_MOD = 12  # request argument class


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two request arguments as text per event, by ``event_id % 12``: 0 no
    criticality, 1 empty limit, 2 criticality in words, 3 limit with a blank,
    4 criticality 0, 5 limit 1001, 6 criticality with a sign, 7 and 8 a number
    beyond 64 bits, 9 criticality 11, 10 limit 0; others good."""
    s = sec(spark, sf_dir)
    k = F.col("event_id") % REQUEST_MOD
    criticality = (F.when(k == 0, F.lit(None).cast("string")).when(k == 2, "high").when(k == 4, "0")
                   .when(k == 6, "+7").when(k == 7, "9223372036854775808").when(k == 9, "11")
                   .otherwise((F.pmod("criticality", F.lit(10)) + 1).cast("string")))
    limit = (F.when(k == 1, "").when(k == 3, " 10").when(k == 5, "1001").when(k == 8, "99999999999999999999")
             .when(k == 10, "0").otherwise((F.col("event_id") % 1000 + 1).cast("string")))
    return s.select("event_id", criticality.alias("criticality"), limit.alias("limit"))


def sec_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a mix of Unicode white space and look-alikes between words."""
    e = read_table(spark, sf_dir, "events")
    blanks = F.array(*[F.lit(chr(cp)) for cp in BLANK_CODEPOINTS])
    n = len(BLANK_CODEPOINTS)

    def b(shift: int) -> Column:
        return F.element_at(blanks, ((F.col("event_id") + shift) % n + 1).cast("int"))

    msg = F.concat(b(0), b(1), F.col("event_type"), b(2), F.lit("by"), b(3), b(5),
                   F.lit("user"), b(7), F.col("user_id").cast("string"), b(11))
    return e.select("event_id", msg.alias("event_message"))


def sec_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 3339 texts of every event time, by ``event_id % 5``: µs + Z,
    nine digits + Z, +03:00, -05:30, twelve digits + Z."""
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id") % TIME_MOD
    ts = F.col("ts")
    z = format_event_time(ts)
    micro = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    def local(shift: str) -> Column:
        return F.date_format(ts + F.expr(f"INTERVAL {shift}"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    text = (F.when(k == 1, F.concat(micro, F.lit("789Z")))
            .when(k == 2, F.concat(local("3 HOURS"), F.lit("+03:00")))
            .when(k == 3, F.concat(local("-5 HOURS -30 MINUTES"), F.lit("-05:30")))
            .when(k == 4, F.concat(micro, F.lit("123456Z")))
            .otherwise(z))
    return e.select("event_id", text.alias("timestamp"))
