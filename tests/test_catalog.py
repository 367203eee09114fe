"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def in_order(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = [tuple(plain(row[c]) for c in columns) for row in df.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(names) == columns
    expected = [tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()]
    assert in_order(found) == in_order(expected)
    for field in df.schema.fields:
        wanted = SQL_TYPES[field.dataType.simpleString()]
        got = types[field.name]
        assert got == wanted or (wanted == "BIGINT" and got == "HUGEINT"), field.name


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = {(r["split"], r["label"]): r["n"] for r in contract.entry(spark).collect()}
    assert rows == {
        ("validation", 0): 1, ("validation", 1): 13, ("test", 1): 12, ("train", 0): 10, ("train", 1): 50,
    }
