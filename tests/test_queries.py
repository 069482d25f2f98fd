"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from terrakey.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, int, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.9g}"
    return str(v.isoformat() if isinstance(v, datetime.date) else v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    want = sorted([plain(dict(zip(names, row, strict=True))[c]) for c in columns] for row in found.fetchall())
    assert sorted(names) == columns
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_gives_rows(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.schema == registry.QUERIES[name](spark, DATA).schema and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
