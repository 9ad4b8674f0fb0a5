import datetime
import itertools
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from salesmart.operators.ranking import quintile
from salesmart.plans import marts, rfm


def fifth(rank, n):
    """One more than the cut points below a rank: quantiles of 1..n, as exact fractions."""
    return 1 + sum(rank > 1 + Fraction(cut * (n - 1), 5) for cut in range(1, 5))


def first_come(values):
    """Ranks from 1, equal values in the order they come."""
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    return {at: rank for rank, at in enumerate(order, 1)}


def test_quintile_counts_the_cut_points_below(spark):
    sizes = [2, 3, 4, 5, 6, 7, 11, 12, 13, 99, 100, 101, 1000]
    df = spark.createDataFrame(
        [(n, r) for n in sizes for r in range(1, n + 1)], "n long, r long")
    got = {(x.n, x.r): x.q for x in df.withColumn("q", quintile(F.col("r"), F.col("n"))).collect()}
    for n in sizes:
        assert [got[n, r] for r in range(1, n + 1)] == [fifth(r, n) for r in range(1, n + 1)]


def test_one_customer(spark):
    df = spark.createDataFrame([(1, 1)], "r long, n long")
    assert df.select(quintile(F.col("r"), F.col("n"))).first()[0] == 1


def test_all_score_pairs(spark):
    want = {}
    for r, f in itertools.product(range(1, 6), repeat=2):
        if r <= 2:
            want[r, f] = "Lost" if f <= 2 else "At Risk"
        elif f == 1:
            want[r, f] = "New Customers"
        elif r < 5:
            want[r, f] = "Potential" if f <= 3 else "Loyal Customers"
        else:
            want[r, f] = "Loyal Customers" if f <= 3 else "Champions"
    df = spark.createDataFrame(list(want), "r int, f int")
    got = df.select("r", "f", rfm.segment_of(F.col("r"), F.col("f")).alias("s")).collect()
    assert {(x.r, x.f): x.s for x in got} == want
    missing = [(None, s) for s in (None, *range(1, 6))] + [(s, None) for s in range(1, 6)]
    none = spark.createDataFrame(missing, "r int, f int")
    assert {x[0] for x in none.select(
        rfm.segment_of(F.col("r"), F.col("f"))).collect()} == {"Potential"}


def test_segments_of_the_small_star(star):
    raw = marts.rfm_raw(star, 1996)
    table = rfm.rfm_customer_table(rfm.rfm_segments(raw, 1996))
    assert [tuple(r) for r in table.collect()] == [
        ("Alpha", "Potential", 305, 2, 273.12), ("Beta", "Lost", 305, 1, 270.0),
        ("Twin", "Champions", 275, 3, 107.0)]


@pytest.mark.parametrize("n", [1, 4, 500])
def test_scores_with_ties(spark, n):
    """Most customers share one frequency and one last order date."""
    rows = [(f"c{i:04d}", f"1996-0{1 + (i % 9 == 0)}-15", 1 + (i % 7 == 0), 1.0)
            for i in range(n)]
    raw = spark.createDataFrame(
        rows, "customer_name string, day string, frequency long, monetary double").select(
        "customer_name", F.to_date("day").alias("last_order_date"), "frequency", "monetary")
    got = {r.customer_name: (r.r_score, r.f_score)
           for r in rfm.rfm_scores(raw.repartition(5), 1996).collect()}
    if n == 1:
        assert got == {"c0000": (5, 1)}
        return
    rows.sort()
    end = datetime.date(1996, 12, 31)
    recency = first_come([(end - datetime.date.fromisoformat(day)).days for _, day, _, _ in rows])
    frequency = first_come([count for _, _, count, _ in rows])
    assert got == {row[0]: (6 - fifth(recency[i], n), fifth(frequency[i], n))
                   for i, row in enumerate(rows)}
