"""Every registered query against its SQL on the smallest sample tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registered

DATA = registered.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")

CORPUS = registered._corpus_queries()[0]  # tested with the part that they belong to
QUERIES = {k: v for k, v in registered.queries().items() if k not in CORPUS}
EXPECTED = {k: v for k, v in registered.oracle_sql().items() if k not in CORPUS}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{file}'")
    return connection


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        return round(value, 6) + 0.0 if isinstance(value, float) else value

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(EXPECTED) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_query_matches_sql(name, spark, duck):
    found = QUERIES[name](spark, DATA)
    wanted = duck.sql(EXPECTED[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    actual = _sorted_rows(found.columns, found.collect())
    assert actual, "an empty result compares nothing"
    assert actual == _sorted_rows(wanted.columns, wanted.fetchall())


def test_entry_runs(spark):
    assert registered.entry(spark).count() > 0
