"""Targets, scorecard and insights, computed from finished marts.

The inputs are month-sized or ranked results, a few rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesmart.functions.money import achievement_pct, exact_mean, exact_sum
from salesmart.functions.text import (
    label, money_text, percent_text, signed_percent_text)
from salesmart.plans.retention import average_rate

# Default targets, months in a year, and the text for no product.
DEFAULT_MONTHLY_REVENUE = 50_000
DEFAULT_RETENTION = 70
MONTHS_IN_YEAR = 12
NO_PRODUCT = "-"

# Insight thresholds, states and display texts.
STRONG_RETENTION = 70
MEDIUM_RETENTION = 50
FINANCE_TITLE = "Kinerja Keuangan"
CUSTOMER_TITLE = "Kesehatan Pelanggan"
PRODUCT_TITLE = "Produk Unggulan"
PEAK_TEXT = "Puncak: **"
LOW_TEXT = "** | Terendah: **"
STRONG_TEXT = "Retention Kuat ("
MEDIUM_TEXT = "Retention Sedang ("
WEAK_TEXT = "Retention Rendah ("
REVENUE_TEXT = "Rev: **"
CATEGORY_TEXT = "** | Kat: **"


def revenue_vs_target(trend: DataFrame, monthly_target: float) -> DataFrame:
    """Each month's revenue against the target."""
    target = F.lit(float(monthly_target))
    return trend.select(
        "month", "month_name", "total_revenue", target.alias("target"),
        achievement_pct(F.col("total_revenue"), target).alias("achievement_pct"))


def retention_vs_target(retention: DataFrame, target: float) -> DataFrame:
    return retention.select(
        "month", "retention_rate", F.lit(float(target)).alias("target"),
        (F.col("retention_rate") - F.lit(float(target))).alias("gap"))


def formatted_targets(trend: DataFrame, monthly_target: float) -> DataFrame:
    """The revenue target table as report texts; a zero target counts as 0 % achieved."""
    ratio = F.col("total_revenue") / F.nullif(F.col("target"), F.lit(0.0)) * 100
    return revenue_vs_target(trend, monthly_target).select(
        "month", "month_name",
        money_text(F.col("total_revenue")).alias("actual"),
        money_text(F.col("target")).alias("target"),
        percent_text(F.when(F.col("target") == 0, 0.0).otherwise(ratio)).alias("achievement"))


def formatted_retention(retention: DataFrame, target: float) -> DataFrame:
    """The retention target table as report texts."""
    return retention_vs_target(retention, target).select(
        "month",
        percent_text(F.col("retention_rate")).alias("actual_rate"),
        F.lit(f"{target}%").alias("target_rate"),
        signed_percent_text(F.col("gap")).alias("gap"))


def _first_best(name: str, value: str, order: str, largest: bool) -> Column:
    """Name at the largest or smallest value, the earliest of equals; NULL values lose."""
    known = F.col(value).isNotNull()
    if largest:
        key = F.struct(F.col(value), -F.col(order))
        return F.max_by(name, F.when(known, key))
    return F.min_by(name, F.when(known, F.struct(F.col(value), F.col(order))))


def retention_summary(retention: DataFrame, target: float) -> DataFrame:
    """Months at or above the target, mean gap to it and the best month."""
    return retention.agg(
        F.count_if(F.col("retention_rate") >= target).alias("months_on_target"),
        F.lit(MONTHS_IN_YEAR).alias("months_in_year"),
        (exact_mean(F.col("retention_rate")) - float(target)).alias("avg_gap"),
        _first_best("month", "retention_rate", "month", largest=True).alias("best_month"))


def revenue_peak_low(trend: DataFrame) -> DataFrame:
    """Total revenue, and the names of the best and the worst month."""
    return trend.agg(
        exact_sum(F.col("total_revenue")).alias("total_revenue"),
        _first_best("month_name", "total_revenue", "month", largest=True).alias("peak_month"),
        _first_best("month_name", "total_revenue", "month", largest=False).alias("low_month"))


def first_product(products: DataFrame, column: str) -> Column:
    """A column of the top product, as a scalar; NULL when there is none."""
    return products.orderBy(
        F.col("total_revenue").desc_nulls_first(), "product_name", "category_name"
    ).limit(1).select(column).scalar()


def kpi_scorecard(
    trend: DataFrame, retention: DataFrame, retention_before: DataFrame,
    customers: DataFrame, products: DataFrame,
    monthly_target: float = DEFAULT_MONTHLY_REVENUE,
) -> DataFrame:
    """One row of headline figures; zeros and ``-`` for a year without sales."""
    annual_target = F.lit(float(monthly_target)) * MONTHS_IN_YEAR
    row = trend.agg(
        F.coalesce(exact_sum(F.col("total_revenue")), F.lit(0.0)).alias("total_revenue"),
        annual_target.alias("annual_target"))
    average, before = average_rate(retention), average_rate(retention_before)
    return row.select(
        "total_revenue", "annual_target",
        achievement_pct(F.col("total_revenue"), F.col("annual_target"))
        .alias("revenue_achievement_pct"),
        average.alias("avg_retention"),
        (average - before).alias("retention_delta"),
        customers.agg(F.count("*")).scalar().alias("active_customers"),
        F.coalesce(first_product(products, "product_name"), F.lit(NO_PRODUCT))
        .alias("top_product"),
    ).withColumn("top_product_label", label(F.col("top_product"), "scorecard"))


def insights(trend: DataFrame, retention: DataFrame, products: DataFrame) -> DataFrame:
    """One row per topic with data: finance, customer and product."""
    finance = (
        trend.agg(
            F.count("*").alias("rows"),
            exact_sum(F.col("total_revenue")).alias("total"),
            _first_best("month_name", "total_revenue", "month", largest=True).alias("peak"),
            _first_best("month_name", "total_revenue", "month", largest=False).alias("low"))
        .filter(F.col("rows") > 0)
        .select(
            F.lit("finance").alias("kind"), F.lit(FINANCE_TITLE).alias("title"),
            money_text(F.col("total")).alias("value"),
            F.concat(F.lit(PEAK_TEXT), "peak", F.lit(LOW_TEXT), "low", F.lit("**"))
            .alias("detail"),
            F.lit("info").alias("status"))
    )
    kept = F.col("kept")
    strong = (kept > STRONG_RETENTION) & (F.col("growth") > 0)
    medium = kept > MEDIUM_RETENTION
    customer = (
        retention.agg(
            F.count("*").alias("rows"),
            exact_mean(F.col("retention_rate")).alias("kept"),
            exact_mean(F.col("growth_rate")).alias("growth"))
        .filter(F.col("rows") > 0)
        .select(
            F.lit("customer").alias("kind"), F.lit(CUSTOMER_TITLE).alias("title"),
            percent_text(kept).alias("value"),
            F.concat(
                F.when(strong, STRONG_TEXT).when(medium, MEDIUM_TEXT).otherwise(WEAK_TEXT),
                percent_text(kept), F.lit(")")).alias("detail"),
            F.when(strong, "success").when(medium, "info").otherwise("error").alias("status"))
    )
    product = (
        products.orderBy(
            F.col("total_revenue").desc_nulls_first(), "product_name", "category_name")
        .limit(1)
        .select(
            F.lit("product").alias("kind"), F.lit(PRODUCT_TITLE).alias("title"),
            F.col("product_name").alias("value"),
            F.concat(F.lit(REVENUE_TEXT), money_text(F.col("total_revenue")),
                     F.lit(CATEGORY_TEXT), "category_name", F.lit("**")).alias("detail"),
            F.lit("success").alias("status"))
    )
    return finance.unionAll(customer).unionAll(product)
