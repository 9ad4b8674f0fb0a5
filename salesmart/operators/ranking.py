"""Quintiles of first-come ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from salesmart.operators.keys import number_rows, sized_side
from salesmart.sources.staging import stage


def quintile(rank: Column, total: Column) -> Column:
    """Bucket 1..5 of rank 1..n when the cut points are linear quantiles of the ranks.

    The k-th cut is ``1 + (n-1)k/5`` and closes its bucket on the right. ``ntile``
    fills buckets by count instead and differs for most n. A single row is bucket 1.
    """
    steps = F.greatest(total - 1, F.lit(1))
    bucket = F.ceil((rank - 1) * 5 / steps)
    return F.greatest(F.lit(1), bucket).cast("int")


def _last_rank(bucket: Column, total: Column) -> Column:
    """The greatest rank of a bucket below 5."""
    return F.floor(bucket * F.greatest(total - 1, F.lit(1)) / 5) + 1


def value_buckets(values: DataFrame) -> DataFrame:
    """Per measure and value: rows, rows of smaller values, and the buckets of its first and last rank.

    One row per distinct value: the window sees the histogram, not the rows.
    """
    whole = Window.partitionBy("measure")
    so_far = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = values.groupBy("measure", "value").agg(F.count("*").alias("rows")).select(
        "measure", "value", "rows", (F.sum("rows").over(so_far) - F.col("rows")).alias("before"),
        F.sum("rows").over(whole).alias("total"))
    return counted.select(
        "*", quintile(F.col("before") + 1, F.col("total")).alias("first"),
        quintile(F.col("before") + F.col("rows"), F.col("total")).alias("last"))


def inner_cuts(values: DataFrame, buckets: DataFrame, tie: str) -> DataFrame:
    """Per measure and value that holds a cut point: the ties at which its buckets end.

    Four cut points to a measure, so at most four values are ranked inside, whatever the number
    of rows; each is ranged over tasks by the tie, however many rows share it.
    """
    cut = buckets.where("first < last")
    ahead = F.sum("rows").over(Window.orderBy("measure", "value")) - F.col("rows")
    wanted = cut.withColumn("ahead", ahead).select(
        "measure", "value", "before", "total", "ahead",
        F.explode(F.sequence("first", F.col("last") - 1)).alias("bucket")).select(
            F.col("measure").alias("of"), F.col("value").alias("at"),
            (_last_rank(F.col("bucket"), F.col("total")) - F.col("before") + F.col("ahead")).alias("place"))
    same = F.col("value").eqNullSafe(F.col("at")) & (F.col("measure") == F.col("of"))
    inside = values.join(
        F.broadcast(cut.select(F.col("measure").alias("of"), F.col("value").alias("at"))), same, "left_semi")
    placed = number_rows(inside.select("measure", "value", tie), ["measure", "value", tie], "place")
    ends = placed.join(F.broadcast(wanted.select("place")), "place")
    return ends.groupBy("measure", "value").agg(F.collect_list(F.struct(F.col(tie).alias("tie"))).alias("ends"))


def with_quintiles(df: DataFrame, measures: Sequence[str], tie: str) -> DataFrame:
    """Add ``<measure>_quintile``: the bucket of the row's rank by a measure, equal values by tie.

    Measures are whole numbers; nulls come first. A value's ranks are a range known from the
    histogram, so only values in which a bucket ends are ordered by the tie. The rows are stored
    once, and meet the histogram by its size: Spark would broadcast them where their file is the smaller.
    """
    stored = stage(df, "measures")
    values = stored.select(tie, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("bigint").alias("value")) for m in measures
    ])).alias("m")).select(tie, "m.*")
    buckets = stage(value_buckets(values), "buckets")
    cuts = stage(inner_cuts(values, buckets, tie), "cuts")
    same = F.col("value").eqNullSafe(F.col("at")) & (F.col("measure") == F.col("of"))
    # Four rows to a measure at most.
    marked = buckets.join(F.broadcast(cuts.withColumnsRenamed({"measure": "of", "value": "at"})), same, "left")
    scored = stored
    for measure in measures:
        mine = marked.where(F.col("measure") == measure).select(
            F.col("value").alias("_value"), F.col("first").alias("_first"), F.col("ends").alias("_ends"))
        after = F.filter("_ends", lambda end: F.when(end["tie"].isNull(), F.col(tie).isNotNull()).otherwise(
            F.coalesce(F.col(tie) > end["tie"], F.lit(False))))
        scored = scored.join(sized_side(mine, buckets), F.col(measure).eqNullSafe(F.col("_value"))).withColumn(
            f"{measure}_quintile", (F.col("_first") + F.coalesce(F.size(after), F.lit(0))).cast("int")
        ).drop("_value", "_first", "_ends")
    return scored
