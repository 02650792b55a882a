"""Every query with a SQL text gives the same rows as that text in another engine."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check import TABLES, canonical  # noqa: E402
from conftest import SMALL  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"create view {table} as select * from read_parquet('{SMALL}/{table}.parquet')")
    return connection


def test_every_text_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, SMALL).toPandas()) > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and all(0 <= r["vegetation"] <= 1 for r in rows)
