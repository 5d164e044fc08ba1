"""Scalar functions: truth tables written from the rules."""

import datetime as dt


from alertflow.functions import (clamp_criticality, color_band, format_event_time, is_rfc3339,
                                 parse_event_time, sanitize_message, severities_at_least,
                                 severity, truncate_message)
from alertflow.functions.text import WHITESPACE_CODEPOINTS
from helpers import column_values


def test_sanitize_trims_and_collapses(spark):
    got = column_values(spark, ["\r\ndoor 7 open", "fan\t\tstopped ", "a b", "\f q  \x0b  w \n e "],
                        sanitize_message)
    assert got == ["door 7 open", "fan stopped", "a b", "q w e"]


def test_sanitize_every_unicode_blank_collapses(spark):
    inputs = [f"a{chr(cp)}{chr(cp)}b{chr(cp)}" for cp in WHITESPACE_CODEPOINTS]
    assert column_values(spark, inputs, sanitize_message) == ["a b"] * len(inputs)


def test_sanitize_lookalikes_are_kept(spark):
    keep = [0x200B, 0xFEFF, 0x180E, 0x1C]
    inputs = [f"a{chr(cp)}b" for cp in keep]
    assert column_values(spark, inputs, sanitize_message) == inputs


def test_sanitize_null_and_blank(spark):
    assert column_values(spark, [None, "   ", ""], sanitize_message) == [None, "", ""]


def test_clamp(spark):
    given = [-(2 ** 40), -7, 0, 1, 2, 6, 9, 10, 11, 2 ** 40]
    assert column_values(spark, given, clamp_criticality, "bigint") == [1, 1, 1, 1, 2, 6, 9, 10, 10, 10]


def test_severity_and_band(spark):
    cs = list(range(0, 12))
    sev = column_values(spark, cs, severity, "bigint")
    assert sev == ["info", "info", "low", "low", "medium", "medium", "medium", "high", "high",
                   "critical", "critical", "critical"]
    band = column_values(spark, cs, color_band, "bigint")
    assert band == ["white", "white", "green", "green", "green", "yellow", "yellow", "orange",
                    "orange", "red", "red", "red"]


def test_severities_at_least():
    assert severities_at_least(9) == ["critical"]
    assert severities_at_least(7) == ["critical", "high"]
    assert severities_at_least(4) == ["critical", "high", "medium"]
    assert severities_at_least(2) == ["critical", "high", "low", "medium"]
    assert severities_at_least(1) == ["critical", "high", "info", "low", "medium"]


VALID_TIMES = ["2031-07-08T04:05:06Z", "2031-07-08T04:05:06-09:30",
               "1999-12-31T23:59:59.987654321Z", "1999-12-31T23:59:59.04Z",
               "2024-02-29T23:59:59.5-05:30", "2031-07-08T04:05:06,25Z",
               "2031-07-08T04:05:06+24:00", "2031-07-08T04:05:06.9876543219876Z"]
INVALID_TIMES = ["", "2031-07-08", "noon", "2024-02-30T10:30:00Z",
                 "2024-01-15T24:00:00Z", "2024-01-15T10:30:60Z", "2024-01-15T10:30:00",
                 "2024-01-15 10:30:00Z", "2024-01-15T10:30:00+0300", "2024-01-15T10:30:00z",
                 "2024-01-15T10:30:00Z\n", "2024-01-15T10:30:00+25:00", "2023-02-29T00:00:00Z",
                 None]


def test_rfc3339_validity(spark):
    assert column_values(spark, VALID_TIMES, is_rfc3339) == [True] * len(VALID_TIMES)
    assert column_values(spark, INVALID_TIMES, is_rfc3339) == [False] * len(INVALID_TIMES)


def test_parse_event_time_instant_and_sub_micros(spark):
    rows = column_values(spark, ["2024-01-15T10:30:00.123456789Z", "2024-01-15T13:30:00+03:00",
                                 "2024-01-15T05:00:00.5-05:30", "2024-01-15T10:30:00.1234567891234Z"],
                         lambda c: parse_event_time(c))
    utc = dt.timezone.utc
    t = [r["time"].replace(tzinfo=None) if r["time"].tzinfo is None else
         r["time"].astimezone(utc).replace(tzinfo=None) for r in rows]
    assert t[0] == dt.datetime(2024, 1, 15, 10, 30, 0, 123456)
    assert t[1] == dt.datetime(2024, 1, 15, 10, 30, 0)
    assert t[2] == dt.datetime(2024, 1, 15, 10, 30, 0, 500000)
    assert [r["time_ns_rem"] for r in rows] == [789, 0, 0, 789]


def test_format_event_time_trims_zeros(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 15, 10, 30, 0), 0), (dt.datetime(2024, 1, 15, 10, 30, 0, 120000), 0),
         (dt.datetime(2024, 1, 15, 10, 30, 0, 123456), 789), (dt.datetime(2024, 1, 15, 10, 30, 0), 5)],
        "t timestamp_ntz, ns smallint")
    got = [r[0] for r in df.select(format_event_time("t", "ns")).collect()]
    assert got == ["2024-01-15T10:30:00Z", "2024-01-15T10:30:00.12Z",
                   "2024-01-15T10:30:00.123456789Z", "2024-01-15T10:30:00.000000005Z"]


def test_truncate_message_counts_bytes(spark):
    given = ["", "k" * 35, "k" * 36, "é" * 17, "é" * 18, "x" + "é" * 18, "€" * 12, "😀" * 9, "y😀" * 9, None]
    got = column_values(spark, given, lambda c: truncate_message(c, 35))
    assert got == ["", "k" * 35, "k" * 32 + "...", "é" * 17, "é" * 16 + "...", "x" + "é" * 15 + "...",
                   "€" * 10 + "...", "😀" * 8 + "...", "y😀" * 6 + "y...", None]
    assert all(g is None or len(g.encode()) <= 35 for g in got)
