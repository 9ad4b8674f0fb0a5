"""Fact selections the marts share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from salesmart.sources.sinks import Star


def category_products(star: Star, categories: Sequence[str] | None) -> DataFrame:
    """Products of the chosen categories; all products when the list is empty."""
    if not categories:
        return star.dim_product
    return star.dim_product.filter(F.col("category_name").isin(list(categories)))


def sales(
    star: Star,
    years: Sequence[int] | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Fact lines of some years and categories.

    The year filter is on the partition column, so other years are never listed
    or read. The category stands on the lines, so its filter reaches the scan too. Every kept
    line has all its dimension rows, so a dimension is joined only where one of its
    attributes is needed.
    """
    lines = star.fact_sales
    if years:
        lines = lines.filter(F.col("order_year").isin(list(years)))
    if categories:
        lines = lines.filter(F.col("category_name").isin(list(categories)))
    return lines


def with_dates(lines: DataFrame, star: Star, *columns: str) -> DataFrame:
    """Add date attributes; Spark broadcasts the dates if their table is small enough."""
    return lines.join(star.dim_date.select("date_key", *columns), "date_key")


def revenue_by(lines: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Revenue in cents per key, with further aggregates."""
    return lines.groupBy(*keys).agg(F.sum("revenue_cents").alias("cents"), *more)
