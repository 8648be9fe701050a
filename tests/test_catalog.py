"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from whenwhere import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("" if x is None else repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    assert got, "a query without rows checks nothing"
    if name in catalog.ORACLE:
        cur = duck.execute(catalog.ORACLE[name])
        there = [c[0] for c in cur.description]
        assert sorted(there) == cols
        assert got == plain(tuple(r[there.index(c)] for c in cols) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
