"""Checks over every registered query: no cartesian products or nested-loop
joins in any plan, and the DuckDB twin has the same column names and types."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from vekta import workloads

# iterative; their sub-plans are tested elsewhere, and so are the corpus queries
SLOW = {"graph_search", "sweep_ivf", "graph_search_checks", "graph_search_recall", "graph_insert_recall", "sweep_graph"}
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<bigint>": "BIGINT[]"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in sorted(f.removesuffix(".parquet") for f in os.listdir(sf) if f.endswith(".parquet")):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(set(workloads.QUERIES) - SLOW))
def test_plan_and_oracle_shape(spark, sf, duck, name):
    df = E.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    sql = E.oracle_sql().get(name)
    if sql is not None:
        rel = duck.sql(sql)
        spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                       for f in df.schema.fields}
        assert spark_types == dict(zip(rel.columns, [str(t) for t in rel.types]))


def test_contract(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    assert [f.name for f in df.schema.fields] == ["k", "recall", "hits", "queries", "missing_truth"]
    assert df.count() >= 0
