"""Every registered query against its SQL twin over whole tables, values and column names."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def settled(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(settled, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


CORE = sorted(n for n in entry.queries() if entry.queries()[n].__module__.split(".")[1] != "llm")


@pytest.mark.parametrize("name", CORE)
def test_query(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(settled(r[c]) for c in cols) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got or name in ("q41_budget_excess",)
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(settled(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0


def test_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
