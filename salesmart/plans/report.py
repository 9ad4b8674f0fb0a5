"""The report's data set: headline figures and its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from salesmart.functions.money import exact_sum
from salesmart.functions.text import label, money_text, percent_text
from salesmart.plans.marts import top_products
from salesmart.plans.retention import average_rate
from salesmart.plans.targets import (
    DEFAULT_MONTHLY_REVENUE, DEFAULT_RETENTION, NO_PRODUCT, first_product,
    formatted_retention, formatted_targets)

# Rows of the report's ranked tables and of the product chart.
REPORT_PRODUCTS = 10
REPORT_CUSTOMERS = 5
CHART_PRODUCTS = 15


def top10_products(products: DataFrame) -> DataFrame:
    """The ten best products, smallest first."""
    return top_products(products, REPORT_PRODUCTS).orderBy(
        F.col("total_revenue").asc(), "product_name", "category_name")


def top15_products(products: DataFrame) -> DataFrame:
    return top_products(products, CHART_PRODUCTS)


def top5_customers(customers: DataFrame) -> DataFrame:
    """The five customers with the highest revenue, with a money text."""
    best = customers.orderBy(
        F.col("monetary_value").desc_nulls_first(), "company_name").limit(REPORT_CUSTOMERS)
    return best.select(
        "company_name", "frequency", money_text(F.col("monetary_value")).alias("total_spent"))


def report_headline(
    trend: DataFrame, retention: DataFrame, products: DataFrame
) -> DataFrame:
    """Total revenue, mean retention, top product and number of months with sales."""
    figures = trend.agg(
        F.coalesce(exact_sum(F.col("total_revenue")), F.lit(0.0)).alias("total"),
        F.count("*").alias("active_months"))
    top = F.coalesce(first_product(products, "product_name"), F.lit(NO_PRODUCT))
    return figures.select(
        money_text(F.col("total")).alias("total_revenue"),
        percent_text(average_rate(retention)).alias("avg_retention"),
        label(top, "report").alias("top_product"),
        "active_months")


def report_tables(
    trend: DataFrame, retention: DataFrame, products: DataFrame, customers: DataFrame,
    monthly_target: float = DEFAULT_MONTHLY_REVENUE, retention_target: float = DEFAULT_RETENTION,
) -> dict[str, DataFrame]:
    return {
        "headline": report_headline(trend, retention, products),
        "revenue": formatted_targets(trend, monthly_target),
        "retention": formatted_retention(retention, retention_target),
        "top_products": top10_products(products),
        "top_customers": top5_customers(customers),
    }


def write_report(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Write each report table to its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{root.rstrip('/')}/{name}")
