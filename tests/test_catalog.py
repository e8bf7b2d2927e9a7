"""Every registered query against its SQL equivalent."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, con, name):
    ok, message = compare(spark, con, sf, name, queries()[name], SQL.get(name))
    assert ok, message


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
