"""The operators that SQL can express, against DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from paperweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, small)
    said = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(said.columns) == columns
    at = [said.columns.index(c) for c in columns]
    exact = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(exact(r[i]) for i in at) for r in said.fetchall()), key=str)
    assert sorted((tuple(exact(r[c]) for c in columns) for r in df.collect()), key=str) == want
