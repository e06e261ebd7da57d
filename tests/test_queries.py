"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def table_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(comparable(r[i]) for i in order) for r in records)


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, database, name):
    found = entry_point.queries()[name](spark, SF_DIR)
    records = found.collect()
    assert records
    if name in entry_point.oracle_sql():
        cursor = database.execute(entry_point.oracle_sql()[name])
        expected = table_of([d[0] for d in cursor.description], cursor.fetchall())
        assert table_of(found.columns, records) == expected


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["query_id", "context"]
