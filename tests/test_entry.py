"""Every query with SQL gives the same rows as DuckDB on the smallest data, where that is present."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from arborix.plans import index, skewed, upkeep

DATA = "/root/testdata/sf0.001"
CORE = {**index.QUERIES, **skewed.QUERIES, **upkeep.QUERIES}
NAMES = sorted({**index.SQL, **skewed.SQL, **upkeep.SQL})
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}" if v != int(v) else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def same(spark, db, query, sql):
    got = query(spark, DATA)
    want = db.sql(sql)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    b = sorted(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert a == b


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    same(spark, db, CORE[name], entry.oracle_sql()[name])


def test_every_query_is_described_and_the_flagship_runs(spark):
    assert all(q.__doc__ for q in entry.queries().values())
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
