"""Credential masking (F9-F11): cases made from the rules themselves."""

import itertools

import pytest

from alertflow.functions import redact, redact_columns
from helpers import column_values

SECRET = "Zq9-kLm_77"


def _r(spark, values, **kw):
    return column_values(spark, values, lambda c: redact(c, **kw))


def _spellings(word):
    return (word, word.upper(), word.capitalize())


@pytest.mark.parametrize("words, label", [
    (("password", "pwd", "pass"), "password"),
    (("client_secret", "secret"), "secret"),
    (("api_key", "api-key", "apikey"), "api_key"),
])
def test_key_and_value_rules(spark, words, label):
    """Every spelling, both signs, blanks and quotes around them; the value ends
    at a blank, a quote or an ampersand."""
    given, want = [], []
    for word, sign, gap, end in itertools.product(words, ":=", ("", " ", "\t", '"', ' "'),
                                                  ("", " next", "&n=1", '" next')):
        for w in _spellings(word):
            given.append(f"user 12 {w}{gap}{sign}{gap}{SECRET}{end}")
            want.append(f"user 12 {label}=***{end}")
    assert _r(spark, given) == want


def test_token_rules(spark):
    """The word token takes what touches it; bearer and authorization take the next word."""
    given = [f"token={SECRET}", f"BEARER {SECRET} end", f"authorization: {SECRET}",
             f"Authorization:Bearer  {SECRET}, then", "tokenless login", f"token {SECRET}"]
    assert _r(spark, given) == ["token=***", "token=*** end", "token=***", "token=*** then",
                                "token=*** login", f"token {SECRET}"]


@pytest.mark.parametrize("scheme", ["http", "https", "nats", "amqp", "redis", "postgres", "mysql"])
def test_url_rule(spark, scheme):
    given = [f"{scheme}://ann:{SECRET}@node-3:99/q", f"dial {scheme}://ann:{SECRET}@node-3 failed",
             f"{scheme}://node-3:99/q", f"{scheme.upper()}://ann:{SECRET}@node-3"]
    assert _r(spark, given) == [f"{scheme}://ann:***@node-3:99/q", f"dial {scheme}://ann:***@node-3 failed",
                                given[2], given[3]]


def test_other_schemes_only_when_asked(spark):
    given = [f"tls://ann:{SECRET}@node-3"]
    assert _r(spark, given) == given
    assert _r(spark, given, extra_schemes=("tls",)) == ["tls://ann:***@node-3"]


def test_unchanged_empty_null(spark):
    plain = "valve 4 opened at level=6 by operator"
    assert _r(spark, [plain, "", None]) == [plain, "", None]
    assert _r(spark, [None], null_as_empty=True) == [""]


def test_truncation_counts_characters(spark):
    given = ["w" * 1000, "w" * 1001, "ü" * 1000, "ü" * 1500 + f" pwd={SECRET}"]
    assert _r(spark, given) == ["w" * 1000, "w" * 1000 + "...[truncated]", "ü" * 1000,
                                "ü" * 1000 + "...[truncated]"]


def test_vertical_tab_is_no_blank(spark):
    assert _r(spark, [f"secret\x0b={SECRET}"]) == [f"secret\x0b={SECRET}"]


def test_redact_columns_only_strings(spark):
    df = spark.createDataFrame([(41, f"pass:{SECRET}", None)], "n bigint, a string, b string")
    r = redact_columns(df, null_as_empty=True).collect()[0]
    assert (r["n"], r["a"], r["b"]) == (41, "password=***", "")
