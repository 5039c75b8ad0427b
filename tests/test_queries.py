"""Every registered query of the engine against DuckDB, whole tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kvspark.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, db, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(db.sql(SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "value"]
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("lost", ["xxhash", "tokenizers"])
def test_entry_outlives_a_missing_library(lost):
    """Where a library of the optional subpackage cannot be imported, the engine's queries are all there."""
    code = f"import sys; sys.modules[{lost!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    n, sql = map(int, done.stdout.split())
    assert done.returncode == 0 and n >= len(QUERIES) and sql >= len(SQL)
    if lost == "xxhash":
        assert (n, sql) == (len(QUERIES), len(SQL))


def test_nothing_else_imports_the_optional_subpackage():
    root = Path(entry.__file__).parent
    for p in (root / "kvspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace("llm_", ""), p
