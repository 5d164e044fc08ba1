"""Plan shape: the plans we want at scale, checked with explain()."""

import re

import pytest

import __spark_entry__ as entry
from alertflow.operators.query import query_events, severity_events
from alertflow.operators.upsert import latest_wins
from alertflow.plans import fixtures as fx
from alertflow.sources.store import read_store_log, write_store
from alertflow.plans.catalog import QUERIES
from conftest import SF001

STREAMS = ("ingest_stream", "ingest_new_checkpoint", "replay_dead_letters", "dead_letters_stored",
           "published_events", "dedup_stream")


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def store(spark):
    from alertflow.session import new_work_dir
    root = new_work_dir(spark, "plans")
    write_store(fx.store_rows(fx.sec_redelivered(spark, SF001)), root, "stream", 0)
    return root


def _formatted(spark, df):
    return df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_flagship_is_top_k_with_pruned_severities(spark, store):
    q = query_events(read_store_log(spark, store), 7, 10)
    phys = _formatted(spark, q)
    assert "TakeOrderedAndProject" in phys
    assert re.search(r"PushedFilters: \[.*In\(severity, \[critical,high\]\)", phys)
    assert phys.count("WindowGroupLimit") >= 2  # both sides of the exchange
    opt = _optimized(q)
    # the criticality filter stays above the window, the severity filter below it
    window_at = opt.index("Window [")
    crit = re.search(r"Filter .*criticality#\d+L? >= 7", opt)
    sev = re.search(r"severity#\d+ IN \(critical,high\)", opt)
    assert crit and crit.start() < window_at
    assert sev and sev.start() > window_at


def test_severity_filter_reaches_the_scan(spark, store):
    phys = _formatted(spark, severity_events(read_store_log(spark, store), "critical"))
    assert re.search(r"PushedFilters: \[.*severity,critical", phys)


def test_building_a_reader_query_runs_nothing(spark):
    """No job, no cache; date and severity bounds below latest-wins, in the SQL form too."""
    names = ("reader_query", "reader_query_wide", "reader_query_sql", "since_events",
             "latest_events", "response_document", "heatmap_reader")
    for name in names:
        entry.queries()[name](spark, SF001)  # the store is written on the first call
    for name in names:
        spark.sparkContext.setJobGroup("build", name)
        q = entry.queries()[name](spark, SF001)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build"), name
        opt = _optimized(q)
        below = opt[opt.index("Window ["):]
        assert re.search(r"event_date#\d+ >= ", below), name
        if name not in ("latest_events",):
            assert re.search(r"severity#\d+ (IN|=)", below), name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_scan_reads_only_needed_columns(spark, store):
    from alertflow.operators.query import count_events
    q = count_events(read_store_log(spark, store))
    phys = q._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "event_message" not in phys.split("ReadSchema")[1].split("\n")[0]


def test_latest_wins_limits_before_shuffle(spark):
    phys = _physical(latest_wins(fx.store_rows(fx.sec(spark, SF001))))
    before, _, after = phys.partition("Exchange")
    assert "WindowGroupLimit" in before and "WindowGroupLimit" in after


def test_no_python_in_any_query(spark):
    for name, fn in entry.queries().items():
        if name not in QUERIES or name in STREAMS:
            continue  # these run streams while building; their operators are covered below
        phys = _physical(fn(spark, SF001))
        for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
            assert node not in phys, (name, node)


def test_decode_filter_stays_above_the_fence(spark):
    from alertflow.operators.process import process
    from alertflow.sources.codec import decode_events
    q = process(decode_events(fx.sec_payload(spark, SF001))).where("disposition = 'stored'")
    opt = _optimized(q)
    # parsing appears once in the plan, and is not copied into the filter
    # (both parses print as static_invoke calls once optimized)
    assert opt.count("lengthOfJsonArray(") == 1 and opt.count("parseJson(") == 1
    filters = [line for line in opt.split("\n") if "Filter" in line]
    assert filters and not any("json" in f.lower() for f in filters)


def test_newest_first_matches_full_scan(spark, store):
    from alertflow.operators.query import query_store_newest_first
    from alertflow.sources.store import read_store
    for n, k in ((9, 5), (9, 40), (1, 1000), (10, 1000)):
        fast = [tuple(r) for r in query_store_newest_first(spark, store, n, k).collect()]
        full = [tuple(r) for r in query_events(read_store(spark, store), n, k,
                                               resolve=False).collect()]
        assert fast == full, (n, k)


def test_response_json_shape(spark, store):
    import json

    from alertflow.operators.query import response_envelope, response_json
    from alertflow.sources.store import read_store
    env = response_envelope(query_events(read_store(spark, store), 5, 3, resolve=False))
    doc = json.loads(response_json(env).collect()[0]["json"])
    assert doc["total"] == 3 and len(doc["events"]) == 3
    assert list(doc["events"][0]) == ["criticality", "timestamp", "eventMessage"]
    times = [e["timestamp"] for e in doc["events"]]
    assert times == sorted(times, reverse=True) and all(t.endswith("Z") for t in times)
    empty = response_envelope(query_events(read_store(spark, store).where("false"), 5, 3,
                                           resolve=False))
    assert json.loads(response_json(empty).collect()[0]["json"]) == {"events": [], "total": 0}


def test_envelope_orders_and_bounds_its_rows(spark):
    import datetime as dt

    from alertflow.operators.query import response_envelope, response_json
    t = dt.datetime(2025, 6, 30, 23, 59, 59, 5)
    rows = [(4, t, 1, "disk almost full"), (6, t, 900, "door forced"), (2, t, 30, "lamp off")]
    df = spark.createDataFrame(rows, "criticality bigint, timestamp timestamp_ntz, "
                                     "time_ns_rem smallint, event_message string")
    env = response_envelope(df)
    assert [e["criticality"] for e in env.collect()[0]["events"]] == [6, 2, 4]
    text = response_json(env).collect()[0]["json"]
    assert "23:59:59.0000059Z" in text and "23:59:59.000005001Z" in text
    many = spark.range(5000).selectExpr("id % 9 + 1 AS criticality", "timestamp_ntz'2025-01-01' AS timestamp",
                                        "cast(0 AS smallint) AS time_ns_rem", "cast(id AS string) AS event_message")
    assert response_envelope(many).collect()[0]["total"] == 1000


def test_since_is_strict_to_the_nanosecond(spark):
    from alertflow.operators.query import filter_since
    df = spark.sql("SELECT timestamp'2025-02-03 04:05:06.000007' AS time, cast(n AS smallint) AS time_ns_rem "
                   "FROM VALUES (0), (499), (500), (501), (999) AS t(n)")
    for since, want in (("2025-02-03T04:05:06.0000075Z", [501, 999]), ("2025-02-03T04:05:06.000006999Z", [0, 499, 500, 501, 999]),
                        ("2025-02-03T04:05:06.000007Z", [499, 500, 501, 999]), (None, [0, 499, 500, 501, 999])):
        assert sorted(r["time_ns_rem"] for r in filter_since(df, since).collect()) == want


def test_missing_from_store_joins_distinct_keys_with_the_date(spark, store):
    from alertflow.operators.report import missing_from_store
    log = read_store_log(spark, store)
    opt = _optimized(missing_from_store(log, log))
    assert re.search(r"Join LeftAnti, .*event_date#\d+ = event_date#\d+", opt)
    assert "Aggregate [" in opt[opt.index("Join LeftAnti"):]
