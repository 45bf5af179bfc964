"""Every registered query against its SQL, run by DuckDB on the same files."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return f"{value:.2f}" if isinstance(value, float) else str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return Counter(tuple(plain(row[n]) for n in order) for row in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    found = rows(result.columns, result.collect())
    assert found
    if name not in ORACLES:
        return
    expected = duck.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(result.columns)
    wanted = rows(columns, expected.fetchall())
    assert sum(found.values()) == sum(wanted.values())
    assert found == wanted, (list((found - wanted))[:3], list((wanted - found))[:3])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1
