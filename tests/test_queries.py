"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from compare import connect, difference
from workload import all_queries

QUERIES = {name: run for name, (run, _) in all_queries().items()}
SQL = {name: sql for name, (_, sql) in all_queries().items() if sql is not None}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, data, name):
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert difference(df, con, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["o_custkey", "c_name", "n_orders", "mean_spent"]
    assert 1 <= df.count() <= 5
