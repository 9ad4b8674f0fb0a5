"""Properties of the physical plans."""

import os
import re

import pytest
from pyspark.sql import Observation, functions as F

from salesmart.operators.hierarchy import parent_name
from salesmart.operators.keys import held_bytes, lookup_key
from salesmart.plans import dashboard, marts, report, retention, rfm
from salesmart.plans.etl import fact_rows
from salesmart.plans.facts import build_fact_sales
from salesmart.registry import lines_by_load
from salesmart.sources import staging
from salesmart.sources.schemas import RAW_SCHEMAS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


MARTS = {
    "trend": lambda s: marts.financial_trend(s, 1996),
    "trend by category": lambda s: marts.financial_trend(s, 1996, ["Drinks"]),
    "clv": lambda s: marts.customer_clv(s, 1996),
    "products": lambda s: marts.product_performance(s, 1996),
    "geo": lambda s: marts.geo_performance(s, 1996),
    "categories": lambda s: marts.category_performance(s, 1996),
    "rfm": lambda s: marts.rfm_raw(s, 1996),
    "retention": lambda s: retention.retention_rate(s, 1996),
    "purchases": marts.customer_purchase_value,
    "quarterly": marts.quarterly_customer_orders,
}


@pytest.mark.parametrize("name", MARTS)
def test_no_python_cross_join_or_wide_read(star, name):
    text = plan(MARTS[name](star))
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in text
    fact_scan = next(m for m in re.findall(r"FileScan parquet \[[^\]]*\]", text)
                     if "order_year" in m)
    for unused in ("unit_price", "discount", "freight", "shipper_key", "total_sales"):
        assert unused not in fact_scan


@pytest.mark.parametrize("name", [m for m in MARTS if m not in ("purchases", "quarterly")])
def test_year_prunes_partitions(star, name):
    text = plan(MARTS[name](star))
    assert re.search(r"PartitionFilters: \[[^\]]*order_year", text)


def test_only_month_sized_windows_are_unpartitioned(star):
    for name in MARTS:
        windows = plan(MARTS[name](star)).count("Window [")
        assert windows == (1 if name == "retention" else 0)


def test_lines_are_aggregated_before_they_meet_a_name(star):
    """The join to the customer names sits above the aggregate by customer key."""
    text = plan(marts.customer_clv(star, 1996))
    join = text.index("Join [customer_key")
    assert text.index("partial_sum(revenue_cents") > join


def test_ranked_marts_keep_only_the_top_rows(star):
    assert "TakeOrderedAndProject(limit=20" in plan(marts.product_performance(star, 1996))
    assert "TakeOrderedAndProject(limit=20" in plan(marts.quarterly_customer_orders(star))


def test_lookups_become_inner_joins(spark, star):
    import fixtures
    raw = fixtures.raw_tables(spark)
    assert raw.keys() == RAW_SCHEMAS.keys()
    text = plan(build_fact_sales(raw["orders"], raw["order_details"], star.tables()))
    assert "LeftOuter" not in text


def test_scores_use_no_global_window_over_customers(star):
    text = plan(rfm.rfm_scores(marts.rfm_raw(star, 1996), 1996))
    for window in re.findall(r"Window \[.*", text):
        assert "customer_name" not in window


BY_CATEGORY = {
    "trend": lambda s: marts.financial_trend(s, 1996, ["Drinks"]),
    "retention": lambda s: retention.retention_rate(s, 1996, ["Drinks"]),
    "clv": lambda s: marts.customer_clv(s, 1996, ["Drinks"]),
    "geo": lambda s: marts.geo_performance(s, 1996, ["Drinks"]),
    "rfm": lambda s: marts.rfm_raw(s, 1996, ["Drinks"]),
}


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", BY_CATEGORY)
def test_category_filter_reaches_the_scan(star, no_broadcasts, name):
    text = plan(BY_CATEGORY[name](star))
    assert "product_key" not in text
    assert re.search(r"PushedFilters: \[[^\]]*category_name", text)


def test_parents_of_many_can_be_split(spark, no_broadcasts):
    people = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 1, id % 50) AS boss", "concat('n', id) AS name")
    text = plan(parent_name(people, "id", "boss", "name", "id", "boss_name", "N/A"))
    join = text[text.index("SortMergeJoin"):]
    assert join.count("Exchange hashpartitioning(boss") == 2
    assert "Aggregate" not in join


def test_a_page_reads_the_fact_eight_times_and_leaves_nothing(spark, star, monkeypatch, tmp_path):
    stored = []

    def counted(df, label):
        stored.append("order_year" in plan(df))
        return staging.stage(df, label)

    monkeypatch.setattr(dashboard, "stage", counted)
    folder = staging.work_folder(spark).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    with staging.staged_tables(spark):
        tables = dashboard.dashboard_tables(star, year=1996)
        report.write_report(tables, str(tmp_path))
        assert not any("order_year" in plan(df) for df in tables.values())
    assert sum(stored) <= 8
    assert set(os.listdir(folder)) == before
    assert spark.read.parquet(f"{tmp_path}/rfm_customer_table").count() == 3


def test_the_fact_is_written_from_its_last_join(spark, star):
    """With every lookup but the product's small, lines are moved for products and for orders only."""
    import fixtures
    raw = fixtures.raw_tables(spark)
    dims = star.tables()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("dim_customer", "dim_employee", "dim_shipper"):
            dims[name] = dims[name].hint("broadcast")
        text = plan(fact_rows(raw, dims, Observation()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"Exchange (hash|range|roundrobin)partitioning\((\w+?)#", text, re.IGNORECASE)
    assert sorted(by for _, by in moved) == ["orderid", "orderid", "productid", "productid"]
    assert "REBALANCE" not in text


@pytest.fixture
def small_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1MB")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def executed(df):
    """The plan as it ran, all its stages done."""
    df.collect()
    return plan(df)


def test_a_large_dimension_in_a_small_file_is_not_broadcast(spark, tmp_path, small_broadcasts):
    """Dense keys pack: 4.8 MB of rows in a file below the limit of 1 MB."""
    path = str(tmp_path / "dim")
    spark.range(200_000).selectExpr("id AS source", "id + 1 AS dim_key", "'x' AS name").write.option(
        "compression", "zstd").parquet(path)
    dim = spark.read.parquet(path)
    lines = spark.range(100).selectExpr("IF(id % 3 = 0, NULL, id * 2500) AS foreign_id")
    few = dim.where("source < 100")
    assert held_bytes(dim.select("source", "dim_key")) == 200_000 * 24 > 1 << 20
    assert held_bytes(few) == 100 * (32 + 1)
    for rows, join in ((dim, "SortMergeJoin"), (few, "BroadcastHashJoin")):
        got = lookup_key(lines, rows, "foreign_id", "source", "dim_key")
        text = executed(got)
        assert join in text and (join == "BroadcastHashJoin") == ("BroadcastExchange" in text)
        want = lines.join(rows.selectExpr("source AS foreign_id", "dim_key"), "foreign_id", "left")
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert lookup_key(lines, dim, "foreign_id", "source", "dim_key").where("dim_key IS NOT NULL").count() == 53


@pytest.mark.parametrize("name", ["clv", "products", "geo", "categories", "rfm", "purchases", "quarterly"])
def test_names_are_merged_with_totals(star, name):
    """A packed dimension is small as a file only; its names are not held by the driver."""
    text = plan(MARTS[name](star))
    key = "product_key" if name in ("products", "categories") else "customer_key"
    assert f"SortMergeJoin [{key}" in text
    assert f"BroadcastHashJoin [{key}" not in text


def test_customers_are_not_broadcast_to_their_scores(spark):
    """The histogram goes to the customers, though Spark takes their file for the smaller side."""
    raw = spark.range(20_000).selectExpr(
        "concat('c', id) AS customer_name", "date_add(DATE'1996-01-01', CAST(id % 300 AS int)) AS last_order_date",
        "id % 40 AS frequency", "CAST(id AS double) AS monetary")
    text = executed(rfm.rfm_scores(raw, 1996)).split("Initial Plan")[0]
    assert "BuildLeft" not in text and text.count("Inner, BuildRight") == 2


def test_lines_meet_orders_once_for_all_loads(spark):
    """Rows as by a semi join to each part's orders, from a table stored once."""
    orders = spark.createDataFrame(
        [(1, 1995), (2, 1996), (3, 1995), (3, 1996), (4, None), (5, 1995), (5, None), (5, 1995), (None, 1996)],
        "orderid long, year int")
    lines = spark.createDataFrame(
        [(1, 10), (1, 10), (2, 20), (3, 30), (4, 40), (5, 50), (6, 60), (None, 70)], "orderid long, productid long")
    older = F.col("year") < 1996
    parts = {"older": older, "newer": ~older}
    got = lines_by_load(orders, lines, parts)
    for name, part in parts.items():
        want = lines.join(orders.where(part).select("orderid"), "orderid", "left_semi")
        assert got[name].columns == want.columns
        assert sorted(got[name].collect()) == sorted(want.collect()) != []
        text = plan(got[name])
        assert "Join" not in text and "Exchange" not in text and "FileScan parquet" in text
