"""Queries of the package that SQL can say, against their SQL over whole tables."""

import os

import duckdb
import pytest

from convoloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(SQL[name])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(name, spark, sf):
    """Every column of every row is computed, which a count wouldn't do."""
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)
