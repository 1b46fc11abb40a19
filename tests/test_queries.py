"""Every registered query with SQL gives the rows of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import pytest
from paperweave import bindings

SQL = bindings.oracle_sql()
#: Queries without SQL: these are held against plain Python in the other tests, and run here.
REST = sorted(set(bindings.queries()) - set(SQL))


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, duck, name):
    df = bindings.queries()[name](spark, small)
    columns = sorted(df.columns)
    said = duck.sql(SQL[name])
    assert sorted(said.columns) == columns
    at = [said.columns.index(c) for c in columns]
    order = lambda r: tuple((x is not None, str(x)) for x in r)
    want = sorted((tuple(plain(r[i]) for i in at) for r in said.fetchall()), key=order)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order) == want


#: Of these no row of the small tables qualifies; their operators are held against plain Python elsewhere.
EMPTY = {"opposite_results_all"}


@pytest.mark.parametrize("name", REST)
def test_runs(spark, small, name):
    df = bindings.queries()[name](spark, small)
    assert len(set(df.columns)) == len(df.columns) and (df.count() > 0) != (name in EMPTY)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
