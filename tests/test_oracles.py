"""Every query that has SQL gives the rows of that SQL, over whole tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert not [d for d in cursor.description if "HUGEINT" in str(d[1]) or "DECIMAL" in str(d[1])]
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_every_query_is_whole(spark):
    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
