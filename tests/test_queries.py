"""Every registered query against its SQL twin in DuckDB, on the smallest tables with a flood in them."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from floodsight.plans.catalog import QUERIES
from floodsight.plans.oracles import SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(comparable(row[n]) for n in order) for row in rows], key=repr)


def test_every_query_has_sql():
    """All of the library's own; of the others those that SQL can express (tests/llm holds the rest against plain versions)."""
    assert set(QUERIES) == set(SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    got = entry.queries()[name](spark, SF)
    cursor = database.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert normal(got.collect(), got.columns) == normal(cursor.fetchall(), columns)


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and {row.rule_type for row in rows} == {"udp"}
