"""Validation (V1), processing order (G1) and query arguments (V2, V3)."""

import pytest

from alertflow.operators.process import INVALID, SANITIZE_FIRST, STORED, process
from alertflow.operators.validate import (InvalidQuery, error_codes, parse_query_args, request_arguments,
                                          validate_query)

TS = "2024-01-15T10:30:00Z"


def _codes(spark, rows):
    df = spark.createDataFrame(rows, "criticality bigint, timestamp string, event_message string")
    return [r[0] for r in df.select(error_codes()).collect()]


def test_criticality_range(spark):
    got = _codes(spark, [(c, TS, "m") for c in (0, 1, 5, 10, 11, -1)])
    oor = ["criticality_out_of_range"]
    assert got == [oor, [], [], [], oor, oor]


def test_message_rules_count_bytes(spark):
    got = _codes(spark, [(5, TS, ""), (5, TS, "a" * 1000), (5, TS, "a" * 1001),
                         (5, TS, "é" * 500), (5, TS, "é" * 501), (5, TS, "   ")])
    assert got == [["message_required"], [], ["message_too_long"], [], ["message_too_long"], []]


def test_all_failures_reported_together(spark):
    got = _codes(spark, [(0, "2024-01-15", ""), (11, "x", "a" * 1001)])
    assert got == [["criticality_out_of_range", "invalid_timestamp", "message_required"],
                   ["criticality_out_of_range", "invalid_timestamp", "message_too_long"]]


def _process(spark, rows, order="validate_first"):
    df = spark.createDataFrame(rows, "criticality bigint, timestamp string, event_message string")
    return [(r["disposition"], r["criticality"], r["event_message"], r["severity"])
            for r in process(df, order).collect()]


def test_order_validate_first_is_the_code_order(spark):
    rows = [(0, TS, "m"), (11, TS, "m"), (5, TS, "    "), (5, TS, "a  " * 400)]
    got = _process(spark, rows)
    assert [g[0] for g in got] == [INVALID, INVALID, STORED, INVALID]
    assert got[2][2] == ""


def test_order_sanitize_first_is_the_documented_order(spark):
    # 1200 bytes that collapse to 799
    rows = [(0, TS, "m"), (11, TS, "m"), (5, TS, "    "), (5, TS, "a  " * 400),
            (5, TS, "\n disk \t  nearly    full ")]
    got = _process(spark, rows, SANITIZE_FIRST)
    assert [g[0] for g in got] == [STORED, STORED, INVALID, STORED, STORED]
    assert (got[0][1], got[0][3]) == (1, "info")
    assert (got[1][1], got[1][3]) == (10, "critical")
    assert got[4][2] == "disk nearly full"


def test_stored_rows_get_identity(spark):
    df = spark.createDataFrame([(7, "2024-01-15T13:30:00.000000123+03:00", " x ")],
                               "criticality bigint, timestamp string, event_message string")
    r = process(df).collect()[0]
    assert r["severity"] == "high" and r["time_ns_rem"] == 123
    assert str(r["event_date"]) == "2024-01-15"


def test_query_args():
    assert parse_query_args({"criticality": "5", "limit": "10"}) == (5, 10)
    for bad in ({}, {"criticality": "5"}, {"limit": "10"}):
        with pytest.raises(InvalidQuery, match="required"):
            parse_query_args(bad)
    with pytest.raises(InvalidQuery, match="criticality must be an integer"):
        parse_query_args({"criticality": "x", "limit": "10"})
    with pytest.raises(InvalidQuery, match="limit must be an integer"):
        parse_query_args({"criticality": "5", "limit": " 10"})
    for c, k in (("99", "10"), ("0", "10"), ("11", "10"), ("5", "0"), ("5", "1001")):
        with pytest.raises(InvalidQuery, match="out of range"):
            parse_query_args({"criticality": c, "limit": k})
    for c, k in (("1", "1"), ("10", "1000"), ("+5", "10")):
        parse_query_args({"criticality": c, "limit": k})
    with pytest.raises(InvalidQuery, match="out of range"):
        parse_query_args({}, missing_as_zero=True)


def test_public_messages():
    for args, text in (({}, "criticality and limit query parameters are required"),
                       ({"criticality": "x", "limit": "1"}, "criticality must be an integer"),
                       ({"criticality": "99", "limit": "10"}, "invalid query parameters")):
        with pytest.raises(InvalidQuery) as e:
            parse_query_args(args)
        assert e.value.public_message == text


def test_validate_query_checks_criticality_first():
    with pytest.raises(InvalidQuery, match="min_criticality"):
        validate_query(0, 0)


def test_requests_on_a_table_equal_the_single_check(spark):
    texts = [None, "", "0", "1", "5", "10", "11", "+7", "-3", " 5", "5 ", "5\n", "1001", "1000", "x", "5.0", "٣",
             "9223372036854775807", "9223372036854775808", "007"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "criticality string, limit string")
    for r in df.select("*", request_arguments().alias("r")).collect():
        try:
            want = (*parse_query_args({"criticality": r["criticality"], "limit": r["limit"]}), None)
        except InvalidQuery as e:
            want = (None, None, e.public_message)
        assert tuple(r["r"]) == want, r
