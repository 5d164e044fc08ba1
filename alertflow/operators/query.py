"""Reader queries over the store."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import MIN_CRITICALITY, SEVERITY_MINIMUM, severities_at_least
from ..functions.timefmt import format_event_time
from ..schema import IDENTITY
from ..sources.codec import wire_json
from ..sources.store import batches_since, read_counts, read_store_log
from .upsert import latest_wins
from .validate import MAX_LIMIT, validate_query

# Newest first; the remaining keys make equal times come back in a fixed order.
def newest_first() -> list[Column]:
    return [F.col("time").desc(), F.col("time_ns_rem").desc_nulls_last(),
            F.col("severity").asc(), F.col("criticality").desc(),
            F.col("event_message").asc()]


def _resolve(store: DataFrame, resolve: bool, severities: list[str] | None = None) -> DataFrame:
    if severities is not None:
        # severity is part of the identity: this filter is safe below latest-wins
        # and prunes the store's severity partitions
        store = store.where(F.col("severity").isin(severities))
    return latest_wins(store) if resolve else store


def result_columns(df: DataFrame) -> DataFrame:
    """``criticality, timestamp, time_ns_rem, event_message`` (F5, F6): missing values
    read as 0 / ''; ``time_ns_rem`` holds the time's digits below the microsecond."""
    return df.select(F.coalesce(F.col("criticality"), F.lit(0)).cast("bigint").alias("criticality"),
                     F.col("time").alias("timestamp"),
                     F.coalesce(F.col("time_ns_rem"), F.lit(0)).cast("smallint").alias("time_ns_rem"),
                     F.coalesce(F.col("event_message"), F.lit("")).alias("event_message"))


def _since(since) -> tuple[_dt.datetime, int] | None:
    """``since`` as a naive UTC time and its digits 7 to 9; None for no bound."""
    if since is None:
        return None
    ns = 0
    if isinstance(since, str):
        digits = re.search(r"[.,](\d+)", since)
        if digits:
            ns = int(digits[1].ljust(9, "0")[6:9])
            since = since.replace(digits[0], "." + digits[1].ljust(6, "0")[:6])
        since = _dt.datetime.fromisoformat(since.replace("Z", "+00:00"))
    if isinstance(since, _dt.date) and not isinstance(since, _dt.datetime):
        since = _dt.datetime(since.year, since.month, since.day)
    if since.tzinfo is not None:
        since = since.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return None if since.year <= 1 else (since, ns)


def filter_since(df: DataFrame, since) -> DataFrame:
    """Strictly after ``since`` (P3), to the nanosecond; ``None`` or the zero time
    means no bound.

    ``since`` is a datetime (naive = UTC) or RFC 3339 / ISO text.  The bound is
    a literal of the time column's own type, so the filter reaches the scan;
    the date bound that follows from it goes below latest-wins.
    """
    bound = _since(since)
    if bound is None:
        return df
    at, ns = F.lit(bound[0].isoformat(sep=" ")).cast(df.schema["time"].dataType), bound[1]
    later = F.col("time") > at
    if "time_ns_rem" in df.columns:
        later = (F.col("time") >= at) & (later | (F.coalesce(F.col("time_ns_rem"), F.lit(0)) > ns))
    out = df.where(later)
    if "event_date" in df.columns:
        out = out.where(F.col("event_date") >= F.lit(bound[0].date().isoformat()).cast("date"))
    return out


def query_events(store: DataFrame, min_criticality: int, limit: int, since=None,
                 resolve: bool = True) -> DataFrame:
    """The reader query (T1): ``criticality >= n ORDER BY time DESC LIMIT k``.

    Arguments are checked first (V2).  On an unresolved store, the severities
    that ``criticality >= n`` implies are filtered *below* latest-wins
    (partition pruning); the criticality filter itself stays *above* it, so a
    stale copy with a higher criticality cannot come back.  The plan ends in
    ``TakeOrderedAndProject``: each task keeps its own top k, the driver
    merges at most k × tasks rows.
    """
    n, k = validate_query(min_criticality, limit)
    rows = _resolve(store, resolve, severities_at_least(n))
    rows = filter_since(rows.where(F.col("criticality") >= n), since)
    return result_columns(rows.orderBy(*newest_first()).limit(k))


def newest_date_bound(counts: DataFrame, min_criticality: int, k: int) -> DataFrame:
    """One row: the newest date such that it and the dates after it hold ``k`` matches for sure.

    ``counts`` has the identities of each written batch per date and severity.
    Severity is part of the identity, so an identity of a severity that lies
    wholly at or above the minimum still matches however it is rewritten; the
    largest batch of a date counts once, since other batches may hold the same
    identities again.  Fewer matches than ``k``: null, no bound.
    """
    sure = [s for s, low in SEVERITY_MINIMUM.items() if low >= min_criticality]
    per_date = (counts.where(F.col("severity").isin(sure))
                .groupBy("source", "batch_id", "event_date").agg(F.sum("n").alias("n"))
                .groupBy("event_date").agg(F.max("n").alias("n")))
    # one row per date: a running sum over them is small whatever the store
    newest = Window.orderBy(F.col("event_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (per_date.withColumn("reached", F.sum("n").over(newest)).where(F.col("reached") >= k)
            .agg(F.max("event_date").alias("bound")))


def _newest_only(store: DataFrame, counts: DataFrame, min_criticality: int, k: int) -> DataFrame:
    """``store`` cut to the dates that can hold the ``k`` newest matches, and to the
    batches that hold such dates: folders of other batches are not opened.  The bound is
    a subquery: it runs with the query, and nothing runs while this is built."""
    bound = F.coalesce(newest_date_bound(counts, min_criticality, k).scalar(), F.lit("0001-01-01").cast("date"))
    return (store.join(batches_since(counts, bound), ["source", "batch_id"], "left_semi")
            .where(F.col("event_date") >= bound))


def query_store_newest_first(spark: SparkSession, root: str, min_criticality: int,
                             limit: int, since=None) -> DataFrame:
    """The reader query (T1) over a stored table, cut to its newest dates."""
    n, k = validate_query(min_criticality, limit)
    log = _newest_only(read_store_log(spark, root), read_counts(spark, root), n, k)
    return query_events(log, n, k, since=since)


def latest_store_events(spark: SparkSession, root: str, k: int = 10) -> DataFrame:
    """T2 over a stored table, cut to its newest dates."""
    return latest_events(_newest_only(read_store_log(spark, root), read_counts(spark, root),
                                      MIN_CRITICALITY, k), k)


def query_events_sql(spark: SparkSession, view: str, counts_view: str, min_criticality: int,
                     limit: int) -> DataFrame:
    """The same query as SQL text with bound parameters, over a view of the
    resolved store and one of its counts."""
    n, k = validate_query(min_criticality, limit)

    def names(values) -> str:  # fixed names only, never caller text
        return ", ".join(f"'{s}'" for s in values) or "NULL"

    sure = [s for s, low in SEVERITY_MINIMUM.items() if low >= n]
    return spark.sql(
        f"WITH per_batch AS (SELECT event_date, sum(n) AS n FROM {counts_view} "
        f"WHERE severity IN ({names(sure)}) GROUP BY source, batch_id, event_date), "
        f"per_date AS (SELECT event_date, max(n) AS n FROM per_batch GROUP BY event_date), "
        f"reached AS (SELECT event_date, sum(n) OVER (ORDER BY event_date DESC) AS r FROM per_date) "
        f"SELECT coalesce(criticality, 0) AS criticality, time AS timestamp, "
        f"cast(coalesce(time_ns_rem, 0) AS smallint) AS time_ns_rem, "
        f"coalesce(event_message, '') AS event_message FROM {view} "
        f"WHERE criticality >= :min_criticality AND severity IN ({names(severities_at_least(n))}) "
        f"AND event_date >= coalesce((SELECT max(event_date) FROM reached WHERE r >= :lim), "
        f"DATE '0001-01-01') "
        f"ORDER BY time DESC, time_ns_rem DESC, severity, criticality DESC, event_message "
        f"LIMIT :lim",
        args={"min_criticality": n, "lim": k})


def latest_events(store: DataFrame, k: int = 10, resolve: bool = True) -> DataFrame:
    """``SELECT * ORDER BY time DESC LIMIT k``."""
    rows = _resolve(store, resolve)
    return (rows.orderBy(*newest_first()).limit(k)
            .select("time", "time_ns_rem", "severity", "criticality", "event_message"))


def severity_events(store: DataFrame, severity_name: str = "critical",
                    resolve: bool = True) -> DataFrame:
    """``WHERE severity = s ORDER BY time DESC`` (P2), no limit.

    The severity filter prunes partitions and is pushed below latest-wins.
    The final sort is a range-partitioned global sort, so it scales, but a
    caller that does not need the order should drop it.
    """
    rows = _resolve(store, resolve, [severity_name])
    return (rows.orderBy(*newest_first())
            .select("time", "time_ns_rem", "severity", "criticality", "event_message"))


def count_events(store: DataFrame, resolve: bool = True) -> DataFrame:
    """``SELECT count(*)`` (A1) after latest-wins.

    On an unresolved log, latest-wins keeps exactly one row per identity, so
    the count is the number of distinct identities: a hash aggregate on the
    three identity columns (partial aggregation on the map side collapses a
    hot group of copies before the shuffle), with no sort and no other
    column read.  On a store already resolved by ``read_store``
    (``resolve=False``) it is a plain row count.
    """
    if not resolve:
        return store.agg(F.count(F.lit(1)).alias("n"))
    return store.select(*IDENTITY).distinct().agg(F.count(F.lit(1)).alias("n"))


def _newest_first(l: Column, r: Column) -> Column:
    return (F.when(l["_t"] > r["_t"], -1).when(l["_t"] < r["_t"], 1)
            .when(l["_ns"] > r["_ns"], -1).when(l["_ns"] < r["_ns"], 1)
            .when(l["_sev"] < r["_sev"], -1).when(l["_sev"] > r["_sev"], 1)
            .when(l["criticality"] > r["criticality"], -1)
            .when(l["criticality"] < r["criticality"], 1)
            .when(l["eventMessage"] < r["eventMessage"], -1)
            .when(l["eventMessage"] > r["eventMessage"], 1)
            .otherwise(0))


def response_envelope(result: DataFrame, limit: int = MAX_LIMIT) -> DataFrame:
    """Rows → one row ``events: array<struct>, total: bigint``.

    Takes the newest ``limit`` rows itself (at most ``MAX_LIMIT``), so no frame
    can put an unbounded array into the one global group.  ``total`` is the
    number of rows returned, and an empty result gives ``[]``, never NULL.
    The order inside the array is rebuilt with a comparator, since
    ``collect_list`` promises none.
    """
    ns = F.col("time_ns_rem") if "time_ns_rem" in result.columns else F.lit(0)
    sev = F.col("severity") if "severity" in result.columns else F.lit("")
    order = [F.col("timestamp").desc(), ns.desc(), sev.asc(), F.col("criticality").desc(),
             F.col("event_message").asc()]
    bounded = result.orderBy(*order).limit(min(limit, MAX_LIMIT))
    item = F.struct(F.col("timestamp").alias("_t"), ns.cast("smallint").alias("_ns"), sev.alias("_sev"),
                    F.col("criticality").alias("criticality"),
                    F.col("event_message").alias("eventMessage"))
    events = F.transform(F.array_sort(F.collect_list(item), _newest_first),
                         lambda x: F.struct(x["criticality"].alias("criticality"),
                                            x["_t"].alias("timestamp"),
                                            x["_ns"].alias("time_ns_rem"),
                                            x["eventMessage"].alias("eventMessage")))
    return (bounded.agg(events.alias("events"))
            .select("events", F.size("events").cast("bigint").alias("total")))


def response_json(envelope: DataFrame) -> DataFrame:
    """The envelope as wire JSON ``{"events":[...],"total":n}``; times in RFC 3339 UTC
    with up to nine fraction digits."""
    events = F.transform(F.col("events"), lambda x: F.struct(
        x["criticality"].alias("criticality"),
        format_event_time(x["timestamp"], x["time_ns_rem"]).alias("timestamp"),
        x["eventMessage"].alias("eventMessage")))
    return envelope.select(wire_json(F.struct(events.alias("events"),
                                              F.col("total").alias("total"))).alias("json"))
