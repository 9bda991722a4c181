"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle
from rosterspark.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# Filters that leave nothing on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    diff = oracle.compare(spark, con, QUERIES[name], ORACLES[name], FOLDER)
    assert diff is None or (diff == "both empty" and name in MAY_BE_EMPTY), diff


def test_entry(spark):
    assert entry.entry(spark).count() > 0
