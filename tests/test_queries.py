"""Every registered query against its SQL, as DuckDB runs it."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPARK_TYPES = {"VARCHAR": "string", "INTEGER": "int"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    from tablewright.plans.inputs import TABLES

    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def rows(names: list[str], lines: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in one order, every value with its type."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(repr(line[i]) for i in order) for line in lines)


OWN = sorted(name for name in driver.queries() if name.startswith("q_"))


def test_every_query_has_sql():
    assert set(OWN) == {name for name in driver.oracle_sql() if name.startswith("q_")}


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    found = driver.queries()[name](spark, FOLDER)
    expected = duck.execute(driver.oracle_sql()[name])
    types = {c[0]: SPARK_TYPES.get(str(c[1]), str(c[1]).lower()) for c in expected.description}
    assert {f.name: f.dataType.simpleString() for f in found.schema} == types
    wanted = rows([c[0] for c in expected.description], expected.fetchall())
    assert wanted[1]
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == wanted


def test_entry(spark):
    found = driver.entry(spark)
    assert found.columns == ["order_id", "total_amount"]
    assert found.schema["total_amount"].dataType.simpleString() == "decimal(20,2)"
    assert not found.isEmpty()


def test_order_is_total(spark):
    keys = [r["order_id"] for r in driver.queries()["q_total_order"](spark, FOLDER).collect()]
    assert keys == sorted(keys)
