"""Each query with oracle SQL, against DuckDB on the smallest data; stated once more that entry() runs."""

import glob
import math

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr(tuple(clean(r[k]) for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    want = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
