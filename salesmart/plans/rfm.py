"""Recency, frequency and monetary scoring of customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesmart.operators.ranking import with_quintiles

# Customer segments.
CHAMPIONS = "Champions"
LOYAL = "Loyal Customers"
POTENTIAL = "Potential"
NEW = "New Customers"
AT_RISK = "At Risk"
LOST = "Lost"


def rfm_recency(raw: DataFrame, year: int) -> DataFrame:
    """Days from the last order to the end of the year."""
    year_end = F.make_date(F.lit(year), F.lit(12), F.lit(31))
    return raw.withColumn("recency", F.datediff(year_end, F.col("last_order_date")))


def rfm_scores(raw: DataFrame, year: int) -> DataFrame:
    """Recency and frequency scores 1 (worst) to 5 (best).

    Ranks are first-come within equal values, taken in customer-name order. Where a value lies in
    one bucket, its customers are not ordered at all.
    """
    scored = with_quintiles(rfm_recency(raw, year), ["recency", "frequency"], "customer_name")
    return scored.select(
        *raw.columns, "recency", (F.lit(6) - F.col("recency_quintile")).alias("r_score"),
        F.col("frequency_quintile").alias("f_score"))


def segment_of(r: Column, f: Column) -> Column:
    """Segment of a score pair; a missing score falls to the middle segment."""
    return (
        F.when(r.isNull() | f.isNull(), POTENTIAL)
        .when((r <= 2) & (f <= 2), LOST)
        .when((r <= 2) & (f >= 3), AT_RISK)
        .when(f == 1, NEW)
        .when((r == 5) & (f >= 4), CHAMPIONS)
        .when((r == 5) | (f >= 4), LOYAL)
        .otherwise(POTENTIAL)
    )


def rfm_segments(raw: DataFrame, year: int) -> DataFrame:
    return rfm_scores(raw, year).withColumn(
        "segment", segment_of(F.col("r_score"), F.col("f_score")))


def rfm_segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.count("*").alias("customer_count")).orderBy(
        F.desc("customer_count"), "segment")


def rfm_customer_table(segments: DataFrame) -> DataFrame:
    return segments.select(
        "customer_name", "segment", "recency", "frequency", "monetary"
    ).orderBy(F.col("monetary").desc_nulls_first(), "customer_name")
