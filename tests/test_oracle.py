"""Every registered query with an SQL twin equals DuckDB on sf0.001."""

import duckdb
import pytest

from tests.compare import rows
from tidemark.plans.registry import load_all
from tidemark.sources.testdata import TABLES

REG = load_all()
WITH_SQL = sorted(n for n, (_f, sql, _o) in REG.items() if sql)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_sql(spark, sf, con, name):
    fn, sql, _ops = REG[name]
    s_cols, s_rows = rows(fn(spark, sf).toPandas())
    d_cols, d_rows = rows(con.execute(sql).df())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_every_query_runs(spark, sf):
    for name, (fn, _sql, _ops) in REG.items():
        df = fn(spark, sf)
        assert df.schema is not None, name


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
                          cwd=root, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]
