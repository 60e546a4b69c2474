"""Every query that has SQL against DuckDB on the smallest tables; every other runs."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracequarry import queries, queries_code, queries_explore, queries_more, queries_views  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in names)).collect()), key=repr)
    if name in queries.SQL:
        rel = duck.sql(queries.SQL[name])
        assert sorted(rel.columns) == names
        assert rows == sorted((tuple(map(plain, r)) for r in rel.select(*(f'"{c}"' for c in names)).fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
