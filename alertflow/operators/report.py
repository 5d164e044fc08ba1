"""Reports over the store and the dead letters.

Every aggregate here is a hash aggregate with a map-side partial step, so a
key holding a third of all rows is reduced inside each map task before the
shuffle; nothing collects a group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import MAX_CRITICALITY, MIN_CRITICALITY, color_band
from ..functions.text import truncate_message
from ..schema import IDENTITY
from .process import INVALID, MALFORMED, STORED

# Fixed value: the mark drawn under an event's criticality in the heat map.
HEAT_MARK = "█"
LEVELS = tuple(range(MIN_CRITICALITY, MAX_CRITICALITY + 1))


def severity_rollup(store: DataFrame) -> DataFrame:
    """Per severity: row count, first and last event time (A5)."""
    return (store.groupBy("severity")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min("time").alias("first_time"),
                 F.max("time").alias("last_time")))


def error_summary(rejected: DataFrame) -> DataFrame:
    """Failures by code (A6).  A row failing three checks counts under each."""
    return (rejected.select(F.explode("error_codes").alias("error_code"))
            .groupBy("error_code").agg(F.count(F.lit(1)).alias("n")))


def ingest_counters(processed: DataFrame) -> DataFrame:
    """``processed`` (stored), ``errors`` (invalid), ``malformed`` — one row (A3).

    Malformed payloads are not errors in the writer's own counters, so they
    are kept apart.  Also usable inside a stream via ``observe``.
    """
    return processed.agg(*ingest_counter_columns())


def ingest_counter_columns():
    d = F.col("disposition")
    return [F.count_if(d == STORED).alias("processed"),
            F.count_if(d == INVALID).alias("errors"),
            F.count_if(d == MALFORMED).alias("malformed")]


def heatmap_rows(result: DataFrame, width: int = 35, time_col: str = "timestamp",
                 message_col: str = "event_message") -> DataFrame:
    """One row per event with ten level columns ``c1..c10`` (H1).

    A mark under the event's criticality, none when it is outside 1..10; the
    event's own time as ``HH:mm:ss`` (UTC); the message cut for display; the
    colour band name.
    """
    c = F.col("criticality")
    marks = {f"c{k}": F.when(c == k, F.lit(HEAT_MARK)).otherwise(F.lit("")) for k in LEVELS}
    return result.select(
        F.date_format(F.col(time_col), "HH:mm:ss").alias("time_hms"),
        truncate_message(F.col(message_col), width).alias("message"),
        *[col.alias(name) for name, col in marks.items()],
        color_band(c).alias("band"),
        c.alias("criticality"),
    )


def heatmap_matrix(store: DataFrame, bucket: str | None = None,
                   message_col: str = "event_message") -> DataFrame:
    """Message × criticality counts for a whole table, optional time bucket (H2).

    Ten conditional counts in one hash aggregate (one shuffle, partial
    aggregation on the map side) instead of ``pivot``, which plans a second
    aggregation and a second exchange.  ``bucket`` is a ``date_trunc`` unit
    (``'day'``, ``'hour'``...) giving a ``bucket_start`` column.
    """
    keys = [F.col(message_col).alias("message")]
    if bucket:
        keys.append(F.date_trunc(bucket, F.col("time")).alias("bucket_start"))
    c = F.col("criticality")
    return store.groupBy(*keys).agg(*[F.count_if(c == k).alias(f"c{k}") for k in LEVELS])


def _bit(keys: Sequence[str], bits: int):
    """Place of an identity's bit among ``bits``."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(bits))


def identity_bitmap(rows: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """``bucket, bitmap``: one bit per identity of ``rows`` in a bitmap of ``bits`` bits.

    A sort aggregate with a map-side part: a map task sends one 4 KiB bitmap
    per bucket of 32,768 bits, so at most ``bits`` / 8 bytes whatever its rows.
    Copies set the same bit.
    """
    place = _bit(keys, bits)
    return (rows.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")))


def maybe_in(rows: DataFrame, bitmap: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """The rows whose bit is set: all rows of the bitmap's identities and, by
    chance, a share of others (identities in the bitmap / ``bits``).

    The bitmap is broadcast: its size has a fixed bound (``identity_bitmap``).
    """
    place = _bit(keys, bits)
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    small = F.broadcast(bitmap.withColumnRenamed("bucket", "_bucket"))
    return (rows.join(small, F.bitmap_bucket_number(place) == F.col("_bucket"))
            .where(F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1)
            .select(*[rows[c] for c in rows.columns]))


def missing_from_store(source: DataFrame, store: DataFrame, identity: Sequence[str] = IDENTITY,
                       prefilter_bits: int | None = None) -> DataFrame:
    """Source events whose identity never reached the store.

    A left-anti join on the identity and, where both sides have it, the date
    (a function of the identity, so date filters reach both scans).  The
    store side is reduced to its distinct identities before the join, so
    copies of a hot identity shrink on the map side; AQE splits a skewed
    source key.  Every missing source row is returned, copies included.

    ``prefilter_bits`` (2**26 is an 8 MiB bitmap) drops, before any shuffle,
    the store rows that no source row can match: a bitmap of the source's
    identities is tested in the scan of the store, and the candidates are then
    joined exactly, so the rows are the same.  It pays where the source is a
    small part of the store (a day against years); the source is read twice.
    A bitmap too small for the source lets more store rows through, nothing
    else.  Null keys match nothing, with and without it.  Keys of different types
    on the two sides are refused with it.
    """
    keys = list(identity)
    if "event_date" in source.columns and "event_date" in store.columns and "event_date" not in keys:
        keys.append("event_date")
    known = store.select(*keys)
    if prefilter_bits:
        unlike = sorted({k for k, _ in set(source.select(*keys).dtypes) ^ set(known.dtypes)})
        if unlike:  # hashes depend on the type
            raise ValueError(f"prefilter_bits needs keys of the same type on both sides: {unlike}")
        known = maybe_in(known, identity_bitmap(source, keys, prefilter_bits), keys, prefilter_bits)
    return source.join(known.distinct(), on=keys, how="left_anti")
