"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from salesmart.sources.staging import stage


def _stored_least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node.

    Stored, it brings no layout of its own, so the join with the edges shuffles both sides and
    adaptive execution can split a node with very many edges.
    """
    return stage(edges.groupBy("u").agg(F.min("v").alias("low")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = _stored_least(both)
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _stored_least(down)
    tied = (down.join(least, "u").where("v != low")
            .select(F.col("v").alias("u"), F.col("low").alias("v")))
    return tied.union(least.select("u", "low")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not its component's root, the least node.

    ``edges`` has two columns of any ordered type. Rounds grow with the logarithm of the
    longest path; each is stored in the shared folder, so lost executors cost one round.
    """
    current = stage(edges.toDF("u", "v").where("u != v"), "edges")
    before = None
    while True:
        current = stage(_small_star(_large_star(current)), "edges")
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return current.toDF("node", "root")
        before = now
