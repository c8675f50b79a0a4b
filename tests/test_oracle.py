"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries
from clauseflow.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    problem, _ = oracle.compare(spark, duck, name, queries()[name], oracle_sql().get(name), SF_DIR)
    assert problem is None


def test_every_query_of_the_library_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0
