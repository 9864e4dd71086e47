"""Every named query against its SQL in DuckDB, and that both sides are complete."""

from __future__ import annotations

import duckdb
import pytest

from ledgerflow.plans import catalog, catalog_jobs  # noqa: F401

TABLES = ("customer", "events", "lineitem", "orders")


@pytest.fixture(scope="module")
def database(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return connection


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, folder, database, name):
    found = catalog.QUERIES[name](spark, folder)
    wanted = database.execute(catalog.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    ours = sorted((tuple(str(row[c]) for c in columns) for row in found.collect()))
    theirs = sorted(tuple(str(v) for v in row) for row in wanted.fetchall())
    assert ours == theirs
    assert ours
