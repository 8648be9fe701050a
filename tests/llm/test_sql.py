"""The corpus queries that SQL can express, against DuckDB on the given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from whenwhere.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    return sorted(tuple("" if x is None else repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", queries.ORACLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    cur = con.execute(queries.ORACLE[name])
    there = [c[0] for c in cur.description]
    assert sorted(there) == cols
    assert got and got == plain(tuple(r[there.index(c)] for c in cols) for r in cur.fetchall())


def test_registry():
    """Every registered query can be called, and whatever is given as SQL is text."""
    assert all(callable(q) for q in entry.queries().values())
    assert all(isinstance(s, str) and s.strip() for s in entry.oracle_sql().values())
