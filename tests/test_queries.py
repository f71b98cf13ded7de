"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import weftline.queries as library

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.8g}")
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_as_duckdb(spark, db, name):
    df = library.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = db.sql(library.ORACLES[name])
    assert sorted(found.columns) == columns
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert mine == theirs


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
