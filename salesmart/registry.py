"""Every operator and mart as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from salesmart.functions import cleaning
from salesmart.functions.money import cents_to_double, line_cents
from salesmart.functions.text import LABEL_LIMITS, label
from salesmart.operators import keys
from salesmart.operators.hierarchy import parent_name
from salesmart.plans import dimensions, facts, marts, report, retention, rfm, targets
from salesmart.plans.etl import run_etl
from salesmart.plans.session_warehouse import session_warehouse, warehouse_root
from salesmart.sources import sinks, testdata
from salesmart.sources.schemas import FACT_COLUMNS, FOREIGN_KEYS, schema
from salesmart.sources.sinks import Star
from salesmart.sources.staging import stage, staged_tables

Query = Callable[[SparkSession, str], DataFrame]

YEAR = 1996
CATEGORIES = ["ECONOMY", "LARGE"]
MONTHLY_TARGET = 35_000_000
RETENTION_TARGET = 70


def _plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text and decimals as doubles, so any engine's result compares."""
    plain = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DateType):
            plain[field.name] = F.col(field.name).cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            plain[field.name] = F.col(field.name).cast("double")
    return df.withColumns(plain) if plain else df


def _gaps_as_double(df: DataFrame, column: str) -> DataFrame:
    """A whole-number column with NULLs as double, the type data frames give it."""
    return df.withColumn(column, F.col(column).cast("double"))


# Row-wise and lookup operators on the raw tables.

def _customers_in_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)


def _suppliers_in_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") >= 0)


def clean_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    text = (F.when(segment == "BUILDING", "NULL").when(segment == "FURNITURE", "")
            .when(segment == "MACHINERY", "N/A").otherwise(segment))
    return cleaning.clean_null_tokens(
        testdata.table(spark, sf_dir, "customer").select(
            "c_custkey", "c_name", text.alias("region")))


def normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = testdata.table(spark, sf_dir, "supplier")
    return cleaning.normalize_columns(supplier.toDF(*[c.upper() for c in supplier.columns]))


def add_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = schema("companyname string, phone string, fax string")
    return cleaning.add_missing_columns(testdata.shippers(spark, sf_dir), required)


def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendors = testdata.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplierid"),
        F.col("s_name").alias("supplier_name"), F.col("s_acctbal").alias("balance"))
    items = testdata.products(spark, sf_dir).select(
        F.col("productid").alias("supplierid"), "productname")
    joined = items.join(vendors, "supplierid", "left")
    return cleaning.with_defaults(
        joined, {"supplier_name": dimensions.UNKNOWN, "balance": 0.0})


def lenient_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    source = testdata.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(status == "F", F.date_format(day, "MM/dd/yyyy H:mm"))
        .when(status == "O", F.date_format(day, "yyyy-MM-dd"))
        .otherwise("not a date").alias("day_text"),
        F.when(status == "P", "n.a.").otherwise(F.col("o_totalprice").cast("string"))
        .alias("amount_text"))
    return source.select(
        "o_orderkey",
        cleaning.lenient_date(source, "day_text").alias("parsed_day"),
        cleaning.lenient_number("amount_text").alias("parsed_amount"))


def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's date, written in one of ten ways; the last is no date."""
    day = F.col("o_orderdate").cast("timestamp")
    shapes = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss'+00:00'", "MM/dd/yyyy hh:mm a", "MMM d, yyyy",
              "d-MMM-yyyy", "M/d/yy", "yyyyMMdd", "yyyy/M/d H:mm", "MMMM d, yyyy"]
    texts = F.array(*[F.date_format(day, shape) for shape in shapes], F.lit("not a date"))
    source = testdata.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.get(texts, F.pmod("o_orderkey", F.lit(10)).cast("int")).alias("day_text"))
    return source.select("o_orderkey", cleaning.lenient_date(source, "day_text").alias("parsed_day"))


def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions and wide whole numbers as text; a fraction is no whole number."""
    odd = F.col("l_linenumber") % 2 == 1
    part = F.col("l_partkey").cast("string")
    text = testdata.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderid"), F.col("l_linenumber").alias("line"),
        (F.col("l_quantity") + 0.5).cast("string").alias("quantity"),
        (F.col("l_orderkey").cast("bigint") * 10_000_000_000).cast("string").alias("wide"),
        F.concat(part, F.when(odd, ".5").otherwise(".0")).alias("code"))
    read = cleaning.conform(text, schema(
        "orderid bigint, line bigint, quantity double, wide bigint, code bigint"))
    return _gaps_as_double(read, "code")


def lines_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line revenue where a third of the prices and a third of the discounts are NaN."""
    third = F.col("l_linenumber") % 3
    nan = F.lit(float("nan"))
    lines = testdata.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderid"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.when(third == 0, nan).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("unitprice"),
        F.when(third == 1, nan).otherwise(F.col("l_discount")).alias("discount"))
    cents = line_cents(F.col("quantity"), F.col("unitprice"), F.col("discount"))
    return lines.select("orderid", "line", cents_to_double(cents).alias("total_sales"))


def lines_by_load(orders: DataFrame, lines: DataFrame, parts: Mapping[str, Column]) -> dict[str, DataFrame]:
    """The lines of each part of the orders, parts given as conditions on the orders.

    Lines meet orders once for all parts and are stored: a load reads its lines several times. A
    line whose order id stands in several parts is a line of each of them.
    """
    marks = orders.groupBy("orderid").agg(*[F.bool_or(part).alias(f"_{name}") for name, part in parts.items()])
    marked = lines.join(marks.where(" or ".join(f"_{name}" for name in parts)), "orderid")
    stored = stage(marked, "lines-by-load")
    return {name: stored.where(f"_{name}").select(*lines.columns) for name in parts}


def build_in_two_loads(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Older orders first, then the others appended; the second load is run twice."""
    raw = testdata.raw_tables(spark, sf_dir)
    older = F.year("orderdate") < YEAR
    parts = {"older": older, "newer": ~older}
    with staged_tables(spark):
        lines = lines_by_load(raw["orders"], raw["order_details"], parts)
        for load_id, mode in (("older", "overwrite"), ("newer", "append"), ("newer", "append")):
            part = {"orders": raw["orders"].where(parts[load_id]), "order_details": lines[load_id]}
            run_etl(spark, raw | part, root, mode, load_id)


def etl_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact by source ids, from a warehouse built in two loads, older orders first."""
    star = session_warehouse(spark, sf_dir, build_in_two_loads)
    fact = star.fact_sales
    for dim, key, source in (("dim_customer", "customer_key", "customer_id"), ("dim_product", "product_key", "product_id"),
                             ("dim_employee", "employee_key", "employee_id"), ("dim_shipper", "shipper_key", "shipper_id"),
                             ("dim_date", "date_key", "full_date")):
        fact = fact.join(getattr(star, dim).select(key, source), key)
    return fact.select("order_id", "customer_id", "product_id", "employee_id", "shipper_id", "full_date",
                       "quantity", "total_sales")


def etl_append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and amounts by year where the load of the newer years was run twice."""
    fact = session_warehouse(spark, sf_dir, build_in_two_loads).fact_sales
    return fact.groupBy("order_year").agg(
        F.count("*").alias("line_count"), F.sum("quantity").alias("quantity"),
        cents_to_double(F.sum("revenue_cents")).alias("total_sales"))


def load_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every load of that warehouse joined and kept; a repeated load is there once."""
    audit = sinks.read_table(
        spark, warehouse_root(spark, sf_dir, build_in_two_loads), sinks.AUDIT)
    return audit.where(F.col("name").isin("order_lines", "fact_sales"))


def load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the load read, wrote and lost, table by table and key by key."""
    return sinks.read_table(spark, warehouse_root(spark, sf_dir), sinks.AUDIT)


def full_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = testdata.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return source.select(
        "c_custkey", cleaning.full_name("segment", "c_name").alias("full_name"))


def truncate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "c_name", "c_mktsegment")
    return testdata.table(spark, sf_dir, "customer").select(
        "c_custkey", *[label(text, place).alias(f"{place}_label") for place in LABEL_LIMITS])


def line_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = line_cents(F.col("quantity"), F.col("unitprice"), F.col("discount"))
    return testdata.order_details(spark, sf_dir).select(
        "orderid", "productid", "quantity", cents_to_double(cents).alias("total_sales"))


def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = testdata.customers(spark, sf_dir).select("customerid")
    return keys.number_rows(ids, ["customerid"], "customer_key")


def hierarchy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey").cast("bigint")
    people = testdata.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.nullif(nation, F.lit(0)).alias("parent_id"),
        F.col("c_name").alias("name"))
    named = parent_name(
        people, "id", "parent_id", "name", "id", out="parent_name",
        default=dimensions.NO_SUPERVISOR)
    return _gaps_as_double(named, "parent_id")


def _dims_in_credit(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Star dimensions without overdrawn customers and shippers, whose lines are orphans."""
    star = session_warehouse(spark, sf_dir)
    customers = _customers_in_credit(spark, sf_dir).select(F.col("c_custkey").alias("customer_id"))
    shippers = _suppliers_in_credit(spark, sf_dir).select(F.col("s_suppkey").alias("shipper_id"))
    return star.tables() | {
        "dim_customer": star.dim_customer.join(customers, "customer_id", "left_semi"),
        "dim_shipper": star.dim_shipper.join(shippers, "shipper_id", "left_semi"),
    }


def _resolved_in_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.resolve_keys(
        testdata.orders(spark, sf_dir), testdata.order_details(spark, sf_dir),
        _dims_in_credit(spark, sf_dir))


def key_lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testdata.order_details(spark, sf_dir).select("orderid", "productid", "shipvia")
    dim = _dims_in_credit(spark, sf_dir)["dim_shipper"]
    return _gaps_as_double(
        keys.lookup_key(lines, dim, "shipvia", "shipper_id", "shipper_key"), "shipper_key")


def orphan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.orphan_audit(_resolved_in_credit(spark, sf_dir), FOREIGN_KEYS)


def orphan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = facts.build_fact_sales(
        testdata.orders(spark, sf_dir), testdata.order_details(spark, sf_dir),
        _dims_in_credit(spark, sf_dir))
    return kept.select("order_id", "customer_key", "product_key", "shipper_key", "total_sales")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = testdata.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderid"), "o_orderstatus")
    joined = facts.order_lines(headers, testdata.order_details(spark, sf_dir))
    return joined.groupBy("o_orderstatus").agg(
        F.count("*").alias("line_count"), F.sum("quantity").alias("quantity"))


def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.date_spine(dimensions.order_date_sources(
        testdata.orders(spark, sf_dir), testdata.order_details(spark, sf_dir)))


def extract_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.row_counts(testdata.raw_tables(spark, sf_dir))


# Queries over the star schema.

def _star(query: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(session_warehouse(spark, sf_dir))


def _trend(star: Star) -> DataFrame:
    return marts.financial_trend(star, YEAR)


def _retention(star: Star) -> DataFrame:
    return retention.retention_rate(star, YEAR)


def _products(star: Star) -> DataFrame:
    return marts.product_performance(star, YEAR)


def _customers(star: Star) -> DataFrame:
    return marts.customer_clv(star, YEAR)


def _segments(star: Star) -> DataFrame:
    return rfm.rfm_segments(marts.rfm_raw(star, YEAR), YEAR)


RAW_QUERIES: dict[str, Query] = {
    "clean_null_tokens": clean_null_tokens,
    "normalize_columns": normalize_columns,
    "add_missing_columns": add_missing_columns,
    "fill_defaults": fill_defaults,
    "lenient_parse": lenient_parse,
    "lenient_dates": lenient_dates,
    "lenient_numbers": lenient_numbers,
    "lines_with_nan": lines_with_nan,
    "etl_append": etl_append,
    "etl_append_twice": etl_append_twice,
    "load_ledger": load_ledger,
    "load_audit": load_audit,
    "full_name": full_name,
    "truncate_labels": truncate_labels,
    "line_revenue": line_revenue,
    "surrogate_keys": surrogate_keys,
    "hierarchy_lookup": hierarchy_lookup,
    "key_lookup_left": key_lookup_left,
    "orphan_audit": orphan_audit,
    "orphan_filter": orphan_filter,
    "order_lines": order_lines,
    "date_spine": date_spine,
    "extract_row_counts": extract_row_counts,
}

STAR_QUERIES: dict[str, Query] = {
    name: _star(query) for name, query in {
        "dim_shipper": lambda s: s.dim_shipper,
        "dim_customer": lambda s: s.dim_customer,
        "dim_employee": lambda s: s.dim_employee,
        "dim_product": lambda s: _gaps_as_double(s.dim_product, "units_on_order"),
        "dim_date": lambda s: s.dim_date,
        "fact_sales": lambda s: s.fact_sales.select(*FACT_COLUMNS),
        "etl_row_counts": lambda s: sinks.row_counts(s.tables()),
        "distinct_years": marts.distinct_years,
        "distinct_categories": marts.distinct_categories,
        "financial_trend": _trend,
        "financial_trend_by_category":
            lambda s: marts.financial_trend(s, YEAR, CATEGORIES),
        "customer_first_purchase": lambda s: retention.customer_first_purchase(s, YEAR),
        "monthly_customers": lambda s: retention.monthly_customers(s, YEAR),
        "retention_rate": _retention,
        "retention_rate_by_category":
            lambda s: retention.retention_rate(s, YEAR, CATEGORIES),
        "retention_yoy_delta": lambda s: retention.retention_yoy_delta(s, YEAR + 1),
        "retention_vs_target":
            lambda s: targets.retention_vs_target(_retention(s), RETENTION_TARGET),
        "retention_summary":
            lambda s: targets.retention_summary(_retention(s), RETENTION_TARGET),
        "customer_clv": _customers,
        "customer_clv_by_category": lambda s: marts.customer_clv(s, YEAR, CATEGORIES),
        "top5_customers": lambda s: report.top5_customers(_customers(s)),
        "product_performance": _products,
        "product_performance_by_category":
            lambda s: marts.product_performance(s, YEAR, CATEGORIES),
        "top10_products": lambda s: report.top10_products(_products(s)),
        "top15_products": lambda s: report.top15_products(_products(s)),
        "category_performance": lambda s: marts.category_performance(s, YEAR),
        "category_share":
            lambda s: marts.category_share(marts.category_performance(s, YEAR)),
        "category_performance_by_category":
            lambda s: marts.category_performance(s, YEAR, CATEGORIES),
        "geo_performance": lambda s: marts.geo_performance(s, YEAR),
        "geo_performance_by_category":
            lambda s: marts.geo_performance(s, YEAR, CATEGORIES),
        "rfm_raw": lambda s: marts.rfm_raw(s, YEAR),
        "rfm_recency": lambda s: rfm.rfm_recency(marts.rfm_raw(s, YEAR), YEAR),
        "rfm_scores": lambda s: rfm.rfm_scores(marts.rfm_raw(s, YEAR), YEAR),
        "rfm_segments": _segments,
        "rfm_segments_by_category":
            lambda s: rfm.rfm_segments(marts.rfm_raw(s, YEAR, CATEGORIES), YEAR),
        "rfm_segment_counts": lambda s: rfm.rfm_segment_counts(_segments(s)),
        "rfm_customer_table": lambda s: rfm.rfm_customer_table(_segments(s)),
        "revenue_vs_target": lambda s: targets.revenue_vs_target(_trend(s), MONTHLY_TARGET),
        "formatted_targets": lambda s: targets.formatted_targets(_trend(s), MONTHLY_TARGET),
        "formatted_retention":
            lambda s: targets.formatted_retention(_retention(s), RETENTION_TARGET),
        "revenue_peak_low": lambda s: targets.revenue_peak_low(_trend(s)),
        "kpi_scorecard": lambda s: targets.kpi_scorecard(
            marts.financial_trend(s, YEAR + 1), retention.retention_rate(s, YEAR + 1),
            _retention(s), marts.customer_clv(s, YEAR + 1),
            marts.product_performance(s, YEAR + 1), MONTHLY_TARGET),
        "insights": lambda s: targets.insights(_trend(s), _retention(s), _products(s)),
        "report_headline":
            lambda s: report.report_headline(_trend(s), _retention(s), _products(s)),
        "customer_purchase_value": marts.customer_purchase_value,
        "quarterly_customer_orders": marts.quarterly_customer_orders,
    }.items()
}


def _as_plain(query: Query) -> Query:
    return lambda spark, sf_dir: _plain(query(spark, sf_dir))


QUERIES: dict[str, Query] = {
    name: _as_plain(query) for name, query in (RAW_QUERIES | STAR_QUERIES).items()}
