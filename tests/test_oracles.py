"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

from graphloom.harness import ORACLES, QUERIES
from tests.oracle import compare, duck

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no test tables in {SF_DIR}")
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, _, _ = compare(name, spark, SF_DIR, con, QUERIES, ORACLES)
    assert problem is None


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
