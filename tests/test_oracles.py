"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
EVERY, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    _, problems = differences(spark, con, name, EVERY[name], SQL[name], SF)
    assert not problems


def test_every_sql_has_a_query():
    assert set(SQL) <= set(EVERY)


def test_entry_gives_rows(spark):
    result = entry(spark)
    assert result.count() == 64
    assert "win_rate" in result.columns
