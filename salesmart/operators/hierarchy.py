"""Self-lookup of a parent's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from salesmart.sources.staging import stage


def parent_name(
    df: DataFrame, id_col: str, parent_col: str, name_col: str, order_col: str,
    out: str, default: str, among: DataFrame | None = None,
) -> DataFrame:
    """Add the name of the row whose id equals the parent id, of ``df`` or of ``among``.

    When an id occurs more than once the row last in ``order_col`` supplies the
    name. No parent, an unknown parent or a parent without a name gives the default.
    """
    parents = (
        (df if among is None else among).filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias(parent_col))
        .agg(F.max_by(F.col(name_col), F.col(order_col)).alias(out))
    )
    # Stored, the parents bring no layout of their own: the join shuffles both sides, and
    # adaptive execution can split a parent with very many children.
    found = df.join(stage(parents, "parents"), parent_col, "left")
    return found.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
