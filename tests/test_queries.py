"""Every registered query against its SQL on the test tables."""

import os

import pytest
from compare import canonical, spark_rows, sql_rows

from __spark_entry__ import entry, oracle_sql, queries
from salesmart.oracle import ORACLES
from salesmart.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= queries().keys()
    assert ORACLES.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    got = canonical(*spark_rows(QUERIES[name](spark, SF_DIR)))
    want = canonical(*sql_rows(SF_DIR, ORACLES[name]))
    assert got[0] == want[0]
    assert len(got[1]) > 0
    assert got[1] == want[1]


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 20
