import random

import pytest
from pyspark.sql import Window, functions as F

from salesmart.operators.hierarchy import parent_name
from salesmart.operators.keys import (
    drop_orphans, lookup_key, number_rows, orphan_audit)


@pytest.mark.parametrize("rows", [0, 1, 7, 5000])
def test_number_rows_is_the_global_row_number(spark, rows):
    values = list(range(rows))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v % 13, f"n{v:05d}") for v in values], "v int, name string")
    got = number_rows(df, ["v", "name"], "rank", total="n")
    want = df.select("*", F.row_number().over(Window.orderBy("v", "name")).cast("bigint")
                     .alias("rank"), F.lit(rows).cast("bigint").alias("n"))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_number_rows_with_one_hot_value(spark):
    """A third of the rows share a value; several partitions take part."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(30_000).select(
            F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000).alias("v"),
            F.format_string("c%08d", "id").alias("name"))
        got = number_rows(df, ["v", "name"], "rank")
        want = df.withColumn("rank", F.row_number().over(Window.orderBy("v", "name")))
        assert got.exceptAll(want.select(got.columns)).count() == 0
        assert got.agg(F.max("rank"), F.countDistinct("rank")).first() == (30_000, 30_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_null_sorts_first_and_gets_a_number(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "id string")
    got = {r.id: r.k for r in number_rows(df, ["id"], "k").collect()}
    assert got == {None: 1, "a": 2, "b": 3}


def test_lookup_never_matches_null(spark):
    facts = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "n int, cid string")
    dim = spark.createDataFrame([("a", 10), (None, 11)], "id string, k int")
    got = lookup_key(facts, dim, "cid", "id", "k")
    assert {r.n: r.k for r in got.collect()} == {1: 10, 2: None, 3: None}


def test_orphans_are_counted_per_key_and_dropped_once(spark):
    df = spark.createDataFrame(
        [(1, 1), (None, 1), (1, None), (None, None)], "a int, b int")
    audit = {r.key_name: r for r in orphan_audit(df, ["a", "b"]).collect()}
    assert {k: r.orphan_rows for k, r in audit.items()} == {"a": 2, "b": 2}
    assert {(r.joined_rows, r.kept_rows) for r in audit.values()} == {(4, 1)}
    assert drop_orphans(df, ["a", "b"]).collect() == [(1, 1)]


def test_hierarchy(spark):
    df = spark.createDataFrame(
        [(1, None, "Ann", 1), (2, 1, "Bob", 2), (3, 9, "Cid", 3), (4, 2, "Dee", 4),
         (2, 1, "Bob II", 5), (5, 6, "Eve", 6), (6, 1, None, 7)],
        "id int, boss int, name string, pos int")
    got = parent_name(df, "id", "boss", "name", "pos", "boss_name", "N/A")
    assert {r.pos: r.boss_name for r in got.collect()} == {
        1: "N/A", 2: "Ann", 3: "N/A", 4: "Bob II", 5: "Ann", 6: "N/A", 7: "Ann"}
