"""Monthly customer retention, growth and churn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from salesmart.functions.money import exact_mean
from salesmart.plans.sales import sales
from salesmart.sources.sinks import Star

_MONTHS = "months"


def customer_activity(
    star: Star, year: int, categories: Sequence[str] | None = None, years: int = 2
) -> DataFrame:
    """Active months of each customer in a year and the years before, ``years`` in all.

    ``months`` has bit ``12 * n + month - 1`` set for a month with a purchase in the n-th of
    the years. The state per customer is two numbers whatever the line count, so one shuffle
    of partial aggregates does the work of a customer-month table joined to its own first
    month. Months come from the date key, so lines meet no date table.
    """
    first = year - years + 1
    lines = sales(star, list(range(first, year + 1)), categories)
    month = F.floor(F.col("date_key") / 100).cast("int") % 100
    position = (F.col("order_year") - first) * 12 + month - 1
    key = F.min("date_key")
    return lines.groupBy("customer_key").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), position)).alias(_MONTHS),
        F.to_date(key.cast("string"), "yyyyMMdd").alias("first_purchase"),
    )


def customer_first_purchase(
    star: Star, year: int, categories: Sequence[str] | None = None
) -> DataFrame:
    """First purchase per customer inside the two-year window."""
    return customer_activity(star, year, categories).select(
        "customer_key", F.col("first_purchase").alias("global_first_purchase"))


def _monthly(activity: DataFrame, year: int, skipped: int = 0) -> DataFrame:
    """Customers per month of a two-year window that starts ``skipped`` years into the bits."""
    window = F.shiftright(F.col(_MONTHS), 12 * skipped)
    active = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda p: F.bit_get(window, p) == 1)
    per_month = (
        activity
        .select(active.alias("active"))
        .select(F.explode("active").alias("position"), F.element_at("active", 1).alias("first"))
        .groupBy("position")
        .agg(F.count("*").alias("end_customers"),
             F.count_if(F.col("position") == F.col("first")).alias("new_customers"))
    )
    return per_month.select(
        F.when(F.col("position") < 12, year - 1).otherwise(year).alias("year"),
        (F.col("position") % 12 + 1).alias("month"),
        "end_customers", "new_customers")


def monthly_customers(
    star: Star, year: int, categories: Sequence[str] | None = None
) -> DataFrame:
    """Customers active in each month, and those whose first purchase is in it."""
    return _monthly(customer_activity(star, year, categories), year)


def _percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to two decimals, in decimal arithmetic; NULL for no whole."""
    base = F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.round(part.cast("decimal(20,0)") * 100 / base, 2).cast("double")


def retention_rate(
    star: Star, year: int, categories: Sequence[str] | None = None
) -> DataFrame:
    """Rates per month of a year against the previous month that has sales."""
    return _rates(monthly_customers(star, year, categories), year)


def _rates(monthly: DataFrame, year: int) -> DataFrame:
    """Rates of a year from the customers per month of two years.

    The year before supplies January's baseline, so the filter on the year comes
    after the window. The window runs over at most 24 rows.
    """
    end, new, start = (F.col(c) for c in ("end_customers", "new_customers", "start_customers"))
    returning = end - new
    return (
        monthly
        .withColumn("start_customers",
                    F.lag("end_customers").over(Window.orderBy("year", "month")))
        .select(
            "year", "month", "start_customers", "end_customers", "new_customers",
            _percent(returning, start).alias("retention_rate"),
            _percent(end - start, start).alias("growth_rate"),
            _percent(start - returning, start).alias("churn_rate"))
        .filter(F.col("year") == year)
        .orderBy("month")
    )


def average_rate(retention: DataFrame, column: str = "retention_rate") -> Column:
    """Scalar mean of a rate; 0 without months, NULL when every month's rate is NULL."""
    return retention.agg(
        F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(exact_mean(F.col(column)))
    ).scalar()


def retention_yoy_delta(
    star: Star, year: int, categories: Sequence[str] | None = None
) -> DataFrame:
    """Mean retention of a year less that of the year before, from one pass over three years."""
    activity = customer_activity(star, year, categories, years=3)
    current = average_rate(_rates(_monthly(activity, year, skipped=1), year))
    previous = average_rate(_rates(_monthly(activity, year - 1), year - 1))
    return star.fact_sales.sparkSession.range(1).select(
        F.lit(year).alias("year"),
        current.alias("avg_retention"),
        previous.alias("prev_avg_retention"),
        (current - previous).alias("retention_delta"))
