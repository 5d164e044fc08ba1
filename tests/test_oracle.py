"""Every registered query against its DuckDB twin at sf0.01 (the driver's gate)."""

import pytest

from conftest import SF01

import __spark_entry__ as entry
from alertflow.plans import catalog
from oracle_compare import compare, duck

QUERIES = {name: entry.queries()[name] for name in catalog.QUERIES}
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    n = compare(df, con, ORACLE[name])
    assert n > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["criticality", "timestamp", "time_ns_rem", "event_message"]
    assert len(df.collect()) == 10
