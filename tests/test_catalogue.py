"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest
from doclattice import catalogue

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, engine, name):
    df = catalogue.queries()[name](spark, str(SF))
    rows = df.collect()
    assert rows
    if name not in catalogue.oracle_sql():
        return
    want = engine.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    got = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=repr)
    assert got == sorted((tuple(norm(r[k]) for k in at) for r in want.fetchall()), key=repr)
