"""Every query with an SQL twin gives the twin's result on the smallest tables."""

import pytest

import __spark_entry__ as entry

from .oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 4


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None
