"""Every query with SQL against DuckDB on the smallest tables; every other one for rows that can be read."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    held = duckdb.connect()
    for name in os.listdir(ROOT):
        held.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{ROOT}/{name}')")
    return held


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, ROOT)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert len(set(columns)) == len(columns)
    sql = entry.oracle_sql().get(name)
    if sql:
        relation = tables.execute(sql)
        names = [d[0] for d in relation.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    import pathlib

    package = pathlib.Path(entry.__file__).parent / "palimp"
    for source in package.rglob("*.py"):
        if "llm" not in source.relative_to(package).parts:
            assert "palimp.llm" not in source.read_text()
