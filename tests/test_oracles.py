"""Every registered query against its SQL at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert not df.isEmpty()


def test_comparison_notices_differences(spark, con):
    df = spark.range(3)
    assert compare(df, con, "select range as id from range(3)") is None
    assert compare(df, con, "select range as id from range(4)")
    assert compare(df, con, "select range + 1 as id from range(3)")


def test_entry(spark):
    assert {r["direction"]: r["n"] for r in entry(spark).collect()} == {"conflict": 45, "equal": 53, "l2r": 45, "r2l": 37}
