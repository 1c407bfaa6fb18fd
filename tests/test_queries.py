"""Every registered query against its checking SQL."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    ok, note, _ = check.compare(spark, connection, name, SF_DIR, queries()[name], ORACLES.get(name))
    assert ok, note


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(queries())
