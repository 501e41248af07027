"""Every registered query against DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

# Those of the optional subpackage have tests of their own.
QUERIES, SQL = entry.QUERIES, entry.SQL


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


# A plan has none of these: products of two sides, and rows going through Python.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "InArrow")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if name != "row_function":
        assert [word for word in UNWANTED if word in plan] == []
    if name in SQL:
        assert compare(df, connection, SQL[name]) == []
    assert not df.isEmpty()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_the_comparison_sees_differences(spark, sf_dir, connection):
    df = QUERIES["count_rows"](spark, sf_dir)
    assert compare(df, connection, "SELECT count(*) + 1 AS n FROM lineitem")
    assert compare(df, connection, "SELECT count(*) AS m FROM lineitem")
    twice = "SELECT * FROM (SELECT count(*) AS n FROM lineitem), range(2) r(i)"
    assert compare(df, connection, f"SELECT n FROM ({twice})")


def test_entry(spark):
    assert entry.entry(spark).columns == ["c_mktsegment", "n", "rank"]
    assert not entry.entry(spark).isEmpty()
