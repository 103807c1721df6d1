"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from leadmill.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


def _same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 9) if isinstance(v, (int,)) or hasattr(v, "as_tuple") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = sorted((tuple(_same(dict(zip(rel.columns, r))[c]) for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(_same(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_sightings_are_all_events(spark, duck):
    got = entry.queries()["a12_sightings"](spark, SF).count(), duck.sql(entry.oracle_sql()["a12_sightings"]).fetchall()
    assert got[0] == len(got[1])
    assert "% 97" not in catalog.SIGHTINGS
