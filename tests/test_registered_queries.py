"""Every registered query against its SQL oracle on the smallest tables.

`python tests/oracle.py` runs the same comparison at sf0.01."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    problem = compare(spark, con, SF_DIR, key, QUERIES, ORACLES, empty_ok=True)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
