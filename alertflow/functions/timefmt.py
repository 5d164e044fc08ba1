"""RFC 3339 timestamps with nanoseconds on a microsecond type.

Spark keeps microseconds; an event time has up to nine fraction digits and
those digits belong to the row identity.  We hold the instant truncated to
microseconds in ``time`` and digits 7-9 of the fraction in ``time_ns_rem``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted text form.  Offset required; a fraction of any
# length (point or comma) may follow the seconds.  \z, not $: Java's $ also
# matches before a final line break.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"
# Largest offset the wire format accepts (hours, minutes).
MAX_OFFSET_HOURS = 24
MAX_OFFSET_MINUTES = 60


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parts(s: Column):
    """Pieces of a text already known to match RFC3339 (fixed positions)."""
    zulu = s.endswith("Z")
    zone_len = F.when(zulu, F.lit(1)).otherwise(F.lit(6))
    has_frac = F.substring(s, 20, 1).isin(".", ",")
    frac =F.when(has_frac, s.substr(F.lit(21), F.length(s) - 20 - zone_len)).otherwise(F.lit(""))
    sign = F.when(s.substr(-6, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    off_h = s.substr(-5, 2).try_cast("int")
    off_m = s.substr(-2, 2).try_cast("int")
    offset_sec = F.when(zulu, F.lit(0)).otherwise(sign * (off_h * 3600 + off_m * 60))
    offset_ok = zulu | ((off_h <= MAX_OFFSET_HOURS) & (off_m <= MAX_OFFSET_MINUTES))
    micros_text = F.rpad(F.substring(frac, 1, 6), 6, "0")
    local = F.concat(s.substr(1, 19), F.lit("."), micros_text, F.lit("Z"))
    base = local.try_cast("timestamp")
    ns_rem = F.rpad(F.substring(frac, 7, 3), 3, "0").try_cast("smallint")
    return base, offset_sec, offset_ok, ns_rem


def parse_event_time(c) -> Column:
    """RFC 3339 text → ``struct<time: timestamp, time_ns_rem: smallint>``.

    NULL fields when the text is not a valid RFC 3339 time: shape by regex,
    calendar (30 February, hour 24, second 60) by the cast of the local part,
    and offsets up to 24:60 by our own arithmetic rather than the cast's
    ±18:00 limit.
    """
    s = _col(c)
    base, offset_sec, offset_ok, ns_rem = _parts(s)
    ok = s.rlike(RFC3339) & base.isNotNull() & offset_ok
    t = F.timestamp_micros(F.unix_micros(base) - offset_sec.cast("bigint") * F.lit(1_000_000))
    return F.struct(F.when(ok, t).alias("time"),
                    F.when(ok, ns_rem).alias("time_ns_rem"))


def is_rfc3339(c) -> Column:
    """True when the text is a valid RFC 3339 time (V1b); never NULL."""
    return F.coalesce(parse_event_time(c)["time"].isNotNull(), F.lit(False))


def format_event_time(time, ns_rem=None) -> Column:
    """Instant (+ sub-µs digits) → RFC 3339 text in UTC, trailing zeros trimmed (S3).

    Works on TIMESTAMP (printed in the session zone, which must be UTC) and on
    TIMESTAMP_NTZ holding UTC wall time.
    """
    t = _col(time)
    ns = F.lit(0) if ns_rem is None else F.coalesce(_col(ns_rem), F.lit(0))
    frac9 = F.concat(F.date_format(t, "SSSSSS"), F.lpad(ns.cast("string"), 3, "0"))
    frac = F.regexp_replace(frac9, "0+$", "")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                    F.lit("Z"))
