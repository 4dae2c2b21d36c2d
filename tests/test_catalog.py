"""Every named query against DuckDB over the same tables."""

import os

import pytest

import __spark_entry__ as driver
from atlas.catalog.registry import CHECKS, QUERIES, run
from tests.compare import check_rows, database, spark_rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sql = CHECKS.get(name)
    got = spark_rows(QUERIES[name](spark, FOLDER))
    if sql is None:
        assert got[1]
    else:
        assert got == check_rows(con, sql)


def test_unknown_query(spark):
    with pytest.raises(KeyError):
        run("no such query", spark, FOLDER)


def test_every_check_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    columns = driver.entry(spark).columns
    assert columns[:2] == ["person_name", "view_count"] and len(columns) == 10
