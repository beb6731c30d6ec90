"""Every query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from tidemark.suite import registry

SF = "/root/testdata/sf0.01"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], ORACLES[name]) is None


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES) <= set(ORACLES)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0
    assert "subject" in rows.columns
