"""Every registered query against its SQL, on the smallest of the given data."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    equal, seen = compare(spark, con, SF_DIR, name)
    assert equal, seen


def test_entry(spark):
    assert contract.entry(spark).count() > 0
