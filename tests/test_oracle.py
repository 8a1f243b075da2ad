"""Every registered query beside its SQL twin on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from cairngeo.plans import catalogue
from scripts.check import rows_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[:-8]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(ORACLES[name])
    want_columns, want = rows_of([c[0] for c in result.description], result.fetchall())
    assert columns == want_columns
    assert rows == want


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["fid", "c_name", "c_acctbal", "c_mktsegment", "geometry"]
    assert df.count() > 0
