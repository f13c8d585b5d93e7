"""Every registered query with an oracle equals DuckDB on the smallest test tables."""

import pytest
from conftest import SMALL_DATA

import __spark_entry__ as entry_point
from checks.compare import differences, duck

ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL_DATA)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_point.queries())


@pytest.mark.parametrize("key", list(ORACLES))
def test_matches_oracle(spark, con, key):
    got = entry_point.queries()[key](spark, SMALL_DATA).toPandas()
    assert differences(got, con.sql(ORACLES[key]).df()) is None


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0
