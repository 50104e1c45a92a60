"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from loomstead.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v
    return sorted((tuple(plain(row[i]) for i in order) for row in found), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_each_query_has_sql_or_its_own_test():
    assert set(QUERIES) - set(ORACLES) == {"stream_state", "npi_model"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    expected = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(map(tuple, found.collect()), found.columns) == rows(expected.fetchall(), expected.columns)
