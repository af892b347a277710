"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from check import compare, duck
from hourloom import catalogue, oracles

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()
SQL = oracles.oracle_sql()
# Their columns are the people or projects of the data.
WIDE = {"r13_matrix_wide", "r14_user_wide"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql_and_the_reverse():
    assert set(SQL) | WIDE == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, QUERIES[name], SQL.get(name), SF)
    assert ok, note


def test_entry(spark):
    assert entry_point.entry(spark).columns[:2] == ["id", "name"]
