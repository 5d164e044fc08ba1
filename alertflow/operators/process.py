"""Validate / clean / classify one frame of decoded events.

One ``select`` chain: every row gets a ``disposition`` (``stored``,
``invalid`` or ``malformed``) and its ``error_codes``; stored rows also get
their identity columns.  Nothing is handed to Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import clamp_criticality, severity
from ..functions.text import sanitize_message
from ..functions.timefmt import parse_event_time
from .fence import fence
from .validate import MALFORMED_PAYLOAD, error_codes, error_text

STORED = "stored"
INVALID = "invalid"
MALFORMED = "malformed"
DISPOSITIONS = (STORED, INVALID, MALFORMED)

PROCESSED_COLS = ("criticality", "event_message", "disposition", "error_codes", "time",
                  "time_ns_rem", "severity", "error", "event_date")

VALIDATE_FIRST = "validate_first"
SANITIZE_FIRST = "sanitize_first"


def process(df: DataFrame, order: str = VALIDATE_FIRST,
            columns: Sequence[str] = PROCESSED_COLS) -> DataFrame:
    """Classify decoded events.

    ``validate_first`` (default) is what the writer's code does: check the
    event as received, and only clean a valid one (so criticality 0 and 11
    are rejected and the clamp never changes anything; a blank-only message
    is stored as '').  ``sanitize_first`` is the documented order: clean,
    clamp, then check (0 and 11 are stored as 1 and 10; a blank-only message
    is rejected).

    Input needs ``criticality``, ``timestamp`` (text), ``event_message`` and
    optionally ``malformed``.  Output adds ``disposition``, ``error_codes``,
    ``error``, ``time``, ``time_ns_rem``, ``severity``, ``event_date``; the
    criticality and message columns hold the values as they are at the end of
    the chain (cleaned for stored rows; cleaned first for every row under
    ``sanitize_first``).  ``columns`` names the computed columns to keep: the
    fence holds back column pruning, so a caller that reads few of them
    should say so.
    """
    if order not in (VALIDATE_FIRST, SANITIZE_FIRST):
        raise ValueError(f"unknown order {order!r}")
    malformed = F.col("malformed") if "malformed" in df.columns else F.lit(False)
    # parse the time once; its validity feeds the checks and its value the identity
    df = df.withColumn("_pt", parse_event_time(F.col("timestamp")))
    time_ok = F.coalesce(F.col("_pt.time").isNotNull(), F.lit(False))
    crit, msg = F.col("criticality"), F.col("event_message")
    if order == SANITIZE_FIRST:
        crit, msg = clamp_criticality(crit), sanitize_message(msg)
        codes = error_codes(crit, F.col("timestamp"), msg, time_ok=time_ok)
        valid = F.size(codes) == 0
    else:
        codes = error_codes(crit, F.col("timestamp"), msg, time_ok=time_ok)
        valid = F.size(codes) == 0
        crit = F.when(valid, clamp_criticality(crit)).otherwise(crit)
        msg = F.when(valid, sanitize_message(msg)).otherwise(msg)

    staged = df.withColumns({
        "_malformed": F.coalesce(malformed, F.lit(False)),
        "_codes": codes,
        "criticality": crit,
        "event_message": msg,
    })
    ok = ~F.col("_malformed") & (F.size("_codes") == 0)
    parsed = F.col("_pt")
    out = staged.withColumns({
        "disposition": F.when(F.col("_malformed"), F.lit(MALFORMED))
                        .when(ok, F.lit(STORED)).otherwise(F.lit(INVALID)),
        "error_codes": F.when(F.col("_malformed"), F.array(F.lit(MALFORMED_PAYLOAD)))
                        .otherwise(F.col("_codes")),
        "time": F.when(ok, parsed["time"]),
        "time_ns_rem": F.when(ok, parsed["time_ns_rem"]),
        "severity": F.when(ok, severity(F.col("criticality"))),
    })
    out = out.withColumns({
        "error": F.when(F.col("_malformed"), F.lit("malformed payload"))
                  .otherwise(error_text(F.col("error_codes"))),
        "event_date": F.to_date(F.col("time")),
    })
    out = out.drop("_malformed", "_codes", "_pt", *[c for c in PROCESSED_COLS if c not in columns])
    # computed once per row; a filter on disposition stays above (operators/fence.py)
    return fence(out, columns)


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a processed frame into (stored rows, rejected rows).

    Both are lazy filters of the same plan; inside a micro-batch, persist the
    processed frame first so the input is read once for the two writes.
    """
    return (df.where(F.col("disposition") == STORED),
            df.where(F.col("disposition") != STORED))
