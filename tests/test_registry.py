"""Every query against its SQL in DuckDB, on whole tables of the smallest scale.

No query may compare all pairs of two tables or leave the JVM for Python.
"""

import duckdb
import pytest

import __spark_entry__ as entry_point
from checks.oracle import ORACLE
from checks.queries import QUERIES
from checks.run import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns[:2] == ["id", "name"] and df.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython"):
        assert unwanted not in plan
    result = db.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, result.fetchall())
    assert len(want) > 0 and got == want
