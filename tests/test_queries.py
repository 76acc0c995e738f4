"""Every query against the same statement in SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as driver
from postroom.plans.oracle import all_sql
from postroom.plans.queries import all_queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings"
          " pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield connection
    connection.close()


def _plain(value):
    return int(value) if isinstance(value, decimal.Decimal) and value == int(value) else value


def test_each_query_has_its_statement():
    assert set(all_queries()) == set(all_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query(spark, sql, name):
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = sql.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(_plain(r[i]) for i in order)) for r in result.fetchall())
    assert got == expected and got


def test_entry(spark):
    assert driver.entry(spark).count() == 200
