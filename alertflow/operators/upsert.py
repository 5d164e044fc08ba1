"""Latest write wins per row identity.

The event store replaces a row when the same identity (severity, time,
sub-µs digits) is written again.  Parquet has no MERGE, so the store is an
append log and this operator resolves it on read (and in compaction).

Plan: ``row_number() = 1`` over the identity.  Catalyst turns that into a
``WindowGroupLimit`` on *both* sides of the shuffle, so each map task keeps
one row per identity before anything is exchanged: a group of redelivered
copies holding a third of all rows shrinks to one row per input split before
the shuffle, and the reduce side sorts at most (number of splits) rows for
it.  ``max_by`` on a struct would fall back to a sort aggregate instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ARRIVAL_ORDER, IDENTITY


def latest_wins(df: DataFrame, identity: Sequence[str] = IDENTITY,
                order: Sequence[str] | None = None) -> DataFrame:
    """Keep, for each identity, the row that arrived last.

    ``order`` lists arrival-order columns, greatest wins; defaults to the
    columns of ``ARRIVAL_ORDER`` present in ``df`` (remaining ties broken by
    criticality then message, so the answer never depends on the input's
    partitioning).  Filters on identity columns may be applied before this
    operator (Catalyst pushes them below the window); filters on anything
    else must stay above it, or an older copy could come back.
    """
    if order is None:
        order = [c for c in ARRIVAL_ORDER if c in df.columns]
    if not order:
        raise ValueError("latest_wins needs at least one arrival-order column")
    keys = list(identity)
    if "event_date" in df.columns and "time" in keys and "event_date" not in keys:
        # event_date is a function of time, so the groups are the same; having
        # it in the key lets date filters (partition pruning) go below the window
        keys.append("event_date")
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
