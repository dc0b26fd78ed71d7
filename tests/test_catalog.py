"""Every query with SQL against DuckDB, at the smallest scale."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry
from weftline.plans import catalog

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir("/root/testdata/sf0.001"):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '/root/testdata/sf0.001/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns))) for r in cursor.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
