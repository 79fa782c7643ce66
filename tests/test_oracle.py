"""Every query against its SQL oracle on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    diff, _ = oracle.compare(E.queries()[name](spark, SF), con, SQL[name])
    assert diff is None


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
