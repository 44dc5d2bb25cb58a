"""Every query against its SQL twin, rows and names and values."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodscape.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return c


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    expected = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    got, want = ordered(df.collect(), df.columns), ordered(expected.fetchall(), list(expected.columns))
    assert got == want


def test_entry_has_rows(spark, sf):
    assert catalog.entry(spark, sf).count() > 0


def test_import_without_corpus():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
