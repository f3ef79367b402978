"""Every registered query against its SQL, over the sample tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracles.sql import ORACLES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    ours = entry.queries()[name](spark, FOLDER)
    theirs = duck.sql(entry.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert {c: TYPES[t] for c, t in ours.dtypes} == {
        c: str(t) for c, t in zip(theirs.columns, theirs.types)
    }
    place = [theirs.columns.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in place)) for row in theirs.fetchall())
    actual = sorted(repr(tuple(row[c] for c in columns)) for row in ours.collect())
    assert actual == expected


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
