"""All queries on tables with hot keys, missing keys and unmatched keys.

A third of the orders belong to one customer, a third of the lines to one order
and one product, and dimensions are joined by shuffle instead of broadcast.
"""

import os

import duckdb
import pytest
from compare import canonical, spark_rows, sql_rows

from salesmart.oracle import ORACLES
from salesmart.registry import QUERIES

SOURCE = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="test tables not present")

CHANGES = {
    "orders": """
        SELECT * REPLACE (
            CASE WHEN o_orderkey % 3 = 0 THEN 7
                 WHEN o_orderkey % 50 = 1 THEN 1000000
                 WHEN o_orderkey % 50 = 2 THEN NULL ELSE o_custkey END AS o_custkey,
            CASE WHEN o_orderkey % 40 = 5 THEN NULL ELSE o_orderdate END AS o_orderdate)
        FROM src""",
    "lineitem": """
        SELECT * REPLACE (
            CASE WHEN rowid % 3 = 0 THEN (SELECT min(o_orderkey) FROM orders_src
                                          WHERE year(o_orderdate) = 1996 AND o_orderkey % 3 = 0)
                 ELSE l_orderkey END AS l_orderkey,
            CASE WHEN rowid % 3 = 0 THEN 11 WHEN rowid % 70 = 1 THEN NULL
                 WHEN rowid % 70 = 2 THEN -5 ELSE l_partkey END AS l_partkey,
            CASE WHEN rowid % 90 = 4 THEN NULL ELSE l_suppkey END AS l_suppkey)
        FROM src""",
    "customer": """
        SELECT * REPLACE (
            CASE WHEN c_custkey % 10 = 3 THEN 99 ELSE c_nationkey END AS c_nationkey,
            CASE WHEN c_custkey % 4 = 1 THEN 'Customer of many' ELSE c_name END AS c_name)
        FROM src""",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders_src AS FROM '{SOURCE}/orders.parquet'")
    for file in sorted(os.listdir(SOURCE)):
        name = file.split(".")[0]
        con.execute(f"CREATE OR REPLACE TABLE src AS FROM '{SOURCE}/{file}'")
        sql = CHANGES.get(name, "SELECT * FROM src")
        con.execute(f"COPY ({sql}) TO '{folder}/{file}' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def shuffle_joins(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, shuffle_joins, skewed, name):
    got = canonical(*spark_rows(QUERIES[name](spark, skewed)))
    want = canonical(*sql_rows(skewed, ORACLES[name]))
    assert got == want
    assert got[1]


def test_tables_are_skewed(skewed):
    _, [(rows, hot)] = sql_rows(skewed, """
        SELECT count(*), (SELECT max(n) FROM (
            SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) FROM lineitem""")
    assert hot * 3 >= rows
