"""The operators' queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from routeloom.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(repr, want.select(*cols).fetchall()))
