"""Dense row numbers, surrogate-key lookups and orphan accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from salesmart.sources.staging import stage

_SLOT, _POSITION, _SIZE, _BEFORE = "_slot", "_position", "_size", "_before"


def number_rows(
    df: DataFrame, order_by: Sequence[str], name: str, total: str | None = None
) -> DataFrame:
    """Number all rows 1..n in the given order without a one-task global sort.

    Rows are range-partitioned and sorted, and the layout is stored so that the
    partition sizes and the positions describe the same partitions. The only
    frame that meets in one task holds one row per partition. ``total`` names an
    optional column with the overall row count.
    """
    laid_out = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn(_SLOT, F.spark_partition_id())
        .withColumn(_POSITION, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    stored = stage(laid_out, name)
    sizes = stored.groupBy(_SLOT).agg(F.count("*").alias(_SIZE))
    before = sizes.select(
        _SLOT,
        (F.sum(_SIZE).over(Window.orderBy(_SLOT)) - F.col(_SIZE)).alias(_BEFORE),
        F.sum(_SIZE).over(Window.partitionBy()).alias(_SIZE),
    )
    # One row per partition of the sort, so the broadcast is bounded by the partition count.
    numbered = stored.join(F.broadcast(before), _SLOT).withColumn(
        name, F.col(_BEFORE) + F.col(_POSITION) + 1)
    if total:
        numbered = numbered.withColumn(total, F.col(_SIZE))
    return numbered.drop(_SLOT, _POSITION, _BEFORE, _SIZE)


def held_bytes(df: DataFrame) -> int:
    """Bytes of all rows as Spark holds them: a word for the nulls and for each value, and the texts."""
    held = F.lit(8 * (1 + len(df.columns)))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            held = held + F.coalesce(F.octet_length(field.name), F.lit(0))
    return df.agg(F.sum(held.cast("bigint"))).first()[0] or 0


def sized_side(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """A side of a join, broadcast if its rows as held fit the broadcast limit, else sorted and merged.

    Spark takes the size of a table's files for that of its rows. Dense keys pack to a sixtieth, and
    the driver, which builds a broadcast, would hold all of them; adaptive execution keeps such a
    broadcast, as to merge takes one more shuffle. ``like`` is measured instead of a side that is
    costly to compute. Without a limit Spark decides.
    """
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if limit <= 0:
        return df
    return df.hint("broadcast" if held_bytes(df if like is None else like) <= limit else "merge")


def lookup_key(
    df: DataFrame, dimension: DataFrame, foreign_id: str, dim_id: str, key: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Add a dimension's surrogate key by source id; unresolved rows get a NULL key.

    ``carry`` names attributes that come along with the key.

    A NULL id never matches. The join goes by the size of the dimension's rows, and Spark
    splits hot ids at run time.
    """
    pairs = dimension.filter(F.col(dim_id).isNotNull()).select(
        F.col(dim_id).alias(foreign_id), key, *carry)
    return df.join(sized_side(pairs), foreign_id, "left")


def all_resolved(keys: Sequence[str]) -> Column:
    """Condition that every key was found."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition


def drop_orphans(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.filter(all_resolved(keys))


def orphan_metrics(keys: Sequence[str]) -> list[Column]:
    """Aggregates over looked-up rows: all rows, kept rows, rows lost per key."""
    return [
        F.count(F.lit(1)).alias("joined_rows"),
        F.count_if(all_resolved(keys)).alias("kept_rows"),
        *[F.count_if(F.col(k).isNull()).alias(k) for k in keys],
    ]


def orphan_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: rows whose id found no dimension row, and the totals. One pass."""
    counts = df.agg(*orphan_metrics(keys))
    per_key = F.explode(F.array(*[
        F.struct(F.lit(k).alias("key_name"), F.col(k).alias("orphan_rows")) for k in keys]))
    return counts.select("joined_rows", "kept_rows", per_key.alias("k")).select(
        "k.key_name", "k.orphan_rows", "joined_rows", "kept_rows")
