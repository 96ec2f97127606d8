"""Every registered query against its SQL twin, and the entry point."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, bag  # noqa: E402
from tracefold.plans import QUERIES as PLAIN  # noqa: E402

# The training-data queries have tests of their own, beside the subpackage they belong to.
QUERIES = {k: v for k, v in entry.queries().items() if k in PLAIN}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in PLAIN}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = bag(df.columns, df.collect()), bag(names, cursor.fetchall())
    assert mine == theirs
    assert mine or name in ("g7_check_causation",)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema
