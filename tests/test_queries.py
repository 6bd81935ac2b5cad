"""The registered queries against the SQL that states the same rows, at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from swathe.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want)
    for c in cols:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if got[c].dtype.kind == "f":
            same |= (got[c] - want[c]).abs() <= 2e-6
        assert same.all(), (c, got[~same].head(), want[~same].head())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
