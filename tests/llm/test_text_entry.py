"""Text queries with SQL give the rows that DuckDB gives on the same tables; the others run."""

import glob
import os

import pytest

import __spark_entry__ as entry
from lauda.llm import queries as Q
from tests.test_entry import canon

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_text_query_equals_sql(spark, db, tables, name):
    got, want = canon(entry.queries()[name](spark, tables).toPandas()), canon(db.execute(entry.oracle_sql()[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_text_query_runs(spark, tables, name):
    df = entry.queries()[name](spark, tables)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
