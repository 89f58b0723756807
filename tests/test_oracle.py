"""Every query that has SQL gives the same rows as DuckDB; every other one runs."""

import pytest
from compare import assert_same, connect

from wavetally.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
