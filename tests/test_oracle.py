"""Every named query against its SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    status, n = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert status in ("ok", "rows-only") and n > 0
