"""Every query with SQL gives the rows that DuckDB gives on the same tables; the entry module stands alone."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from lauda.plans import catalogue

duckdb = pytest.importorskip("duckdb")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def canon(df):
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, bool) or type(x).__name__ in ("bool_", "bool"):
            return str(bool(x))
        try:
            return round(float(x), 6) if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(list(x)) if hasattr(x, "__len__") else str(x)

    cols = sorted(df.columns)
    return cols, sorted((tuple(cell(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db(tables):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{tables}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module")
def tables():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, db, tables, name):
    got, want = canon(entry.queries()[name](spark, tables).toPandas()), canon(db.execute(entry.oracle_sql()[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_runs(spark, tables, name):
    df = entry.queries()[name](spark, tables)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_never_imports_the_text_subpackage():
    names = [".".join(p.relative_to(ROOT).with_suffix("").parts) for p in sorted(Path(ROOT,
                "lauda").rglob("*.py")) if "llm" not in p.parts]
    code = "import sys, importlib\nfor n in sys.argv[1:]: importlib.import_module(n.removesuffix('.__init__'))\nassert not any(x.startswith('lauda.llm') for x in sys.modules)"
    subprocess.run([sys.executable, "-c", code, *names], cwd=ROOT, check=True)
