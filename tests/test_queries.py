"""Every registered query of the engine against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from routeloom.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, DIR)
    if name not in catalogue.ORACLE_SQL:
        assert got.count() > 0
        return
    want = db.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    rows = lambda x: sorted(map(repr, x))
    assert rows(tuple(r[c] for c in cols) for r in got.collect()) == rows(want.select(*cols).fetchall())
