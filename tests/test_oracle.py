"""Every query with SQL equals DuckDB on the smallest test folder."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from oracle.compare import check, duck

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    verdict, _ = check(con, SQL[name], entry.queries()[name](spark, SMALL))
    assert verdict == "ok"


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
