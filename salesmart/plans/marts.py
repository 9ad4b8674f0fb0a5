"""Group-by marts over the star schema.

Customer and product marts aggregate by surrogate key first and look names up
afterwards: map-side aggregation shrinks a hot customer or product to one row per
task, the aggregate is already partitioned on the join key, and the fact lines
themselves are never shuffled to meet a dimension. Results group by name, so
distinct keys that share a name merge in the second step. An order has one
customer, so order counts of different customers add up.

Names are joined by sort and merge whatever their number: the totals lie on the join key
already, and a broadcast would have the driver hold every name of the dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from salesmart.functions.money import cents_to_double
from salesmart.plans.sales import category_products, revenue_by, sales, with_dates
from salesmart.sources.sinks import Star

# Rows kept by the ranked marts, and the value factor of the lifetime estimate.
TOP_PRODUCTS = 20
TOP_QUARTER_ROWS = 20
LIFETIME_FACTOR = 1.2


def _revenue() -> Column:
    return cents_to_double(F.sum("cents"))


def distinct_years(star: Star) -> DataFrame:
    """Years of the date dimension, newest first."""
    return star.dim_date.select("year").distinct().orderBy(F.desc("year"))


def distinct_categories(star: Star) -> DataFrame:
    return star.dim_product.select("category_name").distinct().orderBy("category_name")


def default_year(star: Star) -> int | None:
    return star.dim_date.agg(F.max("year")).first()[0]


def financial_trend(star: Star, year: int, categories: Sequence[str] | None = None) -> DataFrame:
    """Revenue and orders per month. An order has one date, so daily order counts add up."""
    daily = revenue_by(
        sales(star, [year], categories), ["date_key"],
        F.countDistinct("order_id").alias("orders"))
    return (
        with_dates(daily, star, "year", "month", "month_name")
        .groupBy("year", "month", "month_name")
        .agg(_revenue().alias("total_revenue"), F.sum("orders").alias("total_orders"))
        .orderBy("year", "month")
    )


def _names(dimension: DataFrame, key: str, *attributes: str) -> DataFrame:
    """Attributes by surrogate key, to be merged with totals by that key."""
    return dimension.select(key, *attributes).hint("merge")


def _customer_totals(
    star: Star, year: int, categories: Sequence[str] | None, attribute: str, *more: Column
) -> DataFrame:
    """Revenue and orders per customer key, with one attribute of the customer."""
    totals = revenue_by(
        sales(star, [year], categories), ["customer_key"],
        F.countDistinct("order_id").alias("orders"), *more)
    return totals.join(_names(star.dim_customer, "customer_key", attribute), "customer_key")


def customer_clv(star: Star, year: int, categories: Sequence[str] | None = None) -> DataFrame:
    """Order frequency, revenue and estimated lifetime value per customer name."""
    return (
        _customer_totals(star, year, categories, "company_name")
        .groupBy("company_name")
        .agg(F.sum("orders").alias("frequency"), _revenue().alias("monetary_value"))
        .withColumn("predicted_clv", F.col("monetary_value") * LIFETIME_FACTOR)
        .orderBy(F.col("monetary_value").desc_nulls_first(), "company_name")
    )


def geo_performance(star: Star, year: int, categories: Sequence[str] | None = None) -> DataFrame:
    """Revenue and orders per country; a missing country is a group of its own."""
    return (
        _customer_totals(star, year, categories, "country")
        .groupBy("country")
        .agg(_revenue().alias("total_revenue"), F.sum("orders").alias("total_orders"))
        .orderBy(F.col("total_revenue").desc_nulls_first(), "country")
    )


def rfm_raw(star: Star, year: int, categories: Sequence[str] | None = None) -> DataFrame:
    """Last order date, order frequency and revenue per customer name."""
    totals = _customer_totals(
        star, year, categories, "company_name", F.max("date_key").alias("date_key"))
    return (
        with_dates(totals, star, "full_date")
        .groupBy(F.col("company_name").alias("customer_name"))
        .agg(F.max("full_date").alias("last_order_date"),
             F.sum("orders").alias("frequency"),
             _revenue().alias("monetary"))
    )


def _product_totals(star: Star, year: int, categories: Sequence[str] | None) -> DataFrame:
    totals = revenue_by(
        sales(star, [year], categories), ["product_key"], F.sum("quantity").alias("quantity"))
    products = category_products(star, categories)
    return totals.join(_names(products, "product_key", "product_name", "category_name"), "product_key")


def product_revenue(star: Star, year: int, categories: Sequence[str] | None = None) -> DataFrame:
    """Revenue and units per product and category name, unranked."""
    return (
        _product_totals(star, year, categories)
        .groupBy("product_name", "category_name")
        .agg(_revenue().alias("total_revenue"), F.sum("quantity").alias("total_sold"))
    )


def top_products(products: DataFrame, rows: int) -> DataFrame:
    """The best-selling products; equal revenue is ordered by name, then category."""
    return products.orderBy(
        F.col("total_revenue").desc_nulls_first(), "product_name", "category_name").limit(rows)


def product_performance(
    star: Star, year: int, categories: Sequence[str] | None = None, rows: int = TOP_PRODUCTS
) -> DataFrame:
    return top_products(product_revenue(star, year, categories), rows)


def category_performance(
    star: Star, year: int, categories: Sequence[str] | None = None
) -> DataFrame:
    return (
        _product_totals(star, year, categories)
        .groupBy("category_name")
        .agg(_revenue().alias("total_revenue"))
        .orderBy(F.col("total_revenue").desc_nulls_first(), "category_name")
    )


def category_share(by_category: DataFrame) -> DataFrame:
    """Each category's part of the whole revenue, from the category mart."""
    whole = by_category.agg(
        F.sum(F.col("total_revenue").cast("decimal(28,2)")).cast("double")).scalar()
    share = F.round(F.col("total_revenue") / F.nullif(whole, F.lit(0.0)), 6)
    return by_category.withColumn("share", share)


def customer_purchase_value(star: Star) -> DataFrame:
    """Revenue per customer name over all years."""
    totals = revenue_by(sales(star), ["customer_key"])
    return (
        totals.join(_names(star.dim_customer, "customer_key", "company_name"), "customer_key")
        .groupBy("company_name")
        .agg(_revenue().alias("total_purchase_value"))
        .orderBy(F.col("total_purchase_value").desc_nulls_first(), "company_name")
    )


def quarterly_customer_orders(star: Star, rows: int = TOP_QUARTER_ROWS) -> DataFrame:
    """First rows of customers by quarter, the busiest customers first in each quarter."""
    lines = with_dates(sales(star), star, "year", "quarter")
    totals = revenue_by(
        lines, ["year", "quarter", "customer_key"],
        F.countDistinct("order_id").alias("orders"))
    return (
        totals.join(_names(star.dim_customer, "customer_key", "company_name"), "customer_key")
        .groupBy("year", "quarter", "company_name")
        .agg(F.sum("orders").alias("order_count"), _revenue().alias("quarter_revenue"))
        .orderBy("year", "quarter", F.col("order_count").desc_nulls_first(), "company_name")
        .limit(rows)
    )
