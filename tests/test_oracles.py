"""Every query with SQL against DuckDB on the same tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from pulsegrid import catalog


def norm(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "" if math.isnan(f) else repr(round(f, 6) + 0.0)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    names = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    found = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == names
    theirs = sorted(tuple(norm(r[cols.index(c)]) for c in names) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).columns
