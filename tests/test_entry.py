"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as series

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def same(df, duck, sql):
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r[n] for n in names) for r in df.collect()) == key(found.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(series.QUERIES))
def test_query(spark, duck, name):
    same(entry.queries()[name](spark, DATA), duck, entry.oracle_sql()[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["event_type", "bucket_ms", "value"]


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
