"""Every registered query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(name, spark, duck):
    df = contract.queries()[name](spark, FOLDER)
    rows = [tuple(row) for row in df.collect()]
    assert rows
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return
    expected = duck.execute(sql)
    columns = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, rows) == _rows(columns, expected.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
