import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesmart.functions import cleaning
from salesmart.functions.calendar import calendar_columns
from salesmart.functions.money import (
    achievement_pct, cents_to_decimal, cents_to_double, exact_mean, line_cents)
from salesmart.functions.text import label, money_text, percent_text, signed_percent_text
from salesmart.sources.schemas import schema


def column(df, name):
    return [r[name] for r in df.collect()]


def test_null_tokens(spark):
    df = spark.createDataFrame([(t, 1) for t in ["NULL", "", "N/A", "nan", "x", " ", None]],
                               "s string, n int")
    assert column(cleaning.clean_null_tokens(df), "s") == [None, None, None, None, "x", " ", None]


def test_names_and_missing_columns(spark):
    df = cleaning.normalize_columns(spark.createDataFrame([(1,)], "OrderID int"))
    full = cleaning.add_missing_columns(df, schema("orderid int, fax string"))
    assert full.columns == ["orderid", "fax"]
    assert full.first() == (1, None)
    assert cleaning.add_missing_columns(full, schema("fax string")) is full


def test_conform_drops_unknown_and_casts(spark):
    df = spark.createDataFrame([("7", "x", "bad"), ("10.0", "NULL", "1.5")],
                               "ID string, Extra string, Price string")
    out = cleaning.conform(df, schema("id bigint, price double, note string"))
    assert [tuple(r) for r in out.collect()] == [(7, None, None), (10, 1.5, None)]


def test_dates(spark):
    texts = ["12/08/1948 0:00", "1/2/2003", "1996-07-04", "1996-07-04 10:11:12",
             "1996-07-04T10:11:12", "1996-07-04 10:11:12.5", "1996/7/4", "19960704",
             "bad", "13/13/1996", "1996-07", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    day = datetime.date(1996, 7, 4)
    assert column(df.select(cleaning.lenient_date(df, "d").alias("d")), "d") == [
        datetime.date(1948, 12, 8), datetime.date(2003, 1, 2), day, day, day, day, day, day,
        None, None, None, None]


def test_dates_from_timestamps(spark):
    df = spark.createDataFrame([(datetime.datetime(1996, 7, 4, 23, 59),)], "d timestamp_ntz")
    assert df.select(cleaning.lenient_date(df, "d")).first()[0] == datetime.date(1996, 7, 4)


def test_numbers_never_nan(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "n string")
    assert column(df.select(cleaning.lenient_number("n").alias("n")), "n") == [
        1.5, None, None, None]


def test_flags(spark):
    df = spark.createDataFrame([("0",), ("1",), ("True",), ("2",), ("x",), (None,)], "f string")
    assert column(df.select(cleaning.lenient_flag(df, "f").alias("f")), "f") == [
        False, True, True, True, None, None]


def test_full_name_keeps_null(spark):
    df = spark.createDataFrame([("A", "B"), (None, "B"), ("A", None)], "f string, l string")
    assert column(df.select(cleaning.full_name("f", "l").alias("n")), "n") == ["A B", None, None]


@pytest.mark.parametrize("price,want", [
    (0.125, 0.12), (0.375, 0.38), (1.005, 1.0), (2.665, 2.66), (2.675, 2.68)])
def test_cent_rounding(spark, price, want):
    assert pd.Series([price]).round(2)[0] == want
    df = spark.createDataFrame([(price,)], "p double")
    cents = line_cents(F.lit(1), F.col("p"), F.lit(0.0))
    row = df.select(cents_to_decimal(cents).alias("d"), cents_to_double(cents).alias("f")).first()
    assert float(row.d) == want and row.f == want


def test_exact_mean_skips_null_and_order(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,), (0.3,)], "x double")
    assert df.agg(exact_mean(F.col("x"))).first()[0] == 0.6 / 3
    assert df.filter("x > 9").agg(exact_mean(F.col("x"))).first()[0] is None


def test_achievement(spark):
    df = spark.createDataFrame([(50.0, 0.0), (50.0, 40.0), (0.0, 10.0)], "a double, t double")
    assert column(df.select(achievement_pct(F.col("a"), F.col("t")).alias("p")), "p") == [
        0.0, 125.0, 0.0]


def test_number_texts(spark):
    values = [0.5, 1.5, 2.5, 1234.5, 1234567.891, -1234.4, 0.25, 0.35, -0.05, 12.25]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(money_text(F.col("x")).alias("m"), percent_text(F.col("x")).alias("p"),
                    signed_percent_text(F.col("x")).alias("s")).collect()
    assert [tuple(r) for r in got] == [
        (f"${v:,.0f}", f"{v:.1f}%", f"{v:+.1f}%") for v in values]
    null = spark.createDataFrame([(None,)], "x double").select(percent_text(F.col("x")))
    assert null.first()[0] == f"{float('nan'):.1f}%"


@pytest.mark.parametrize("place,length,want", [
    ("report", 15, 15), ("report", 16, 15), ("scorecard", 16, 18),
    ("insight", 25, 25), ("insight", 26, 28), ("table", 25, 25), ("table", 26, 25)])
def test_label_lengths(spark, place, length, want):
    df = spark.createDataFrame([("x" * length,)], "t string")
    text = df.select(label(F.col("t"), place)).first()[0]
    assert len(text) == want
    assert text.endswith("...") == (want != length or text != "x" * length)


def test_calendar_against_pandas(spark):
    days = [d.date() for d in pd.date_range("1994-12-25", "1997-01-10")]
    days += [datetime.date(2024, 12, 30), datetime.date(2000, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "full_date date")
    got = df.withColumns(calendar_columns(F.col("full_date"))).collect()
    for row in got:
        t = pd.Timestamp(row.full_date)
        assert (row.date_key, row.year, row.quarter, row.month, row.month_name, row.day) == (
            int(t.strftime("%Y%m%d")), t.year, t.quarter, t.month, t.month_name(), t.day)
        assert (row.day_of_week, row.day_name, row.week_of_year, row.is_weekend) == (
            t.dayofweek + 1, t.day_name(), t.isocalendar().week, t.dayofweek >= 5)
        assert row.is_holiday is False


def test_date_texts_of_other_shapes(spark):
    texts = {
        "1996-01-05T00:00:00Z": 5, "1996-01-05 10:00:00+00:00": 5, "1996-01-05T23:00:00-0500": 5,
        "1996-01-05 10:00 UTC": 5, "01/05/1996 10:00 AM": 5, "1/5/1996 1:30:15 pm": 5,
        "01/05/1996 10:00AM": 5, "Jan 5, 1996": 5, "January 5, 1996": 5, "5-Jan-1996": 5,
        "5 January 1996": 5, "5-jan-96": 5, "1/5/96": 5, "01/05/96 10:00": 5, " 1996-01-05 ": 5,
        "Jan 5, 1996 10:00": 5, "Janx 5, 1996": None, "5-Foo-1996": None, "1996-01-05 99:99": None,
        "13/45/1996": None, "Feb 30, 1996": None, "1/5/9": None, "soon": None,
    }
    df = spark.createDataFrame([(text,) for text in texts], "d string")
    got = {r.d: r.day for r in df.select("d", cleaning.lenient_date(df, "d").alias("day")).collect()}
    assert got == {text: day and datetime.date(1996, 1, day) for text, day in texts.items()}
    years = spark.createDataFrame([("1/5/68",), ("1/5/69",)], "d string")
    assert column(years.select(cleaning.lenient_date(years, "d").alias("d")), "d") == [
        datetime.date(2068, 1, 5), datetime.date(1969, 1, 5)]


def test_fractions_wide_numbers_and_nan(spark):
    df = spark.createDataFrame([("2.5", "2.5", "4000000000"), ("3", "3.0", "NULL"), ("bad", "x", "1")],
                               "quantity string, code string, wide string")
    target = schema("quantity double, code bigint, wide bigint")
    assert [tuple(r) for r in cleaning.conform(df, target).collect()] == [
        (2.5, None, 4_000_000_000), (3.0, 3, None), (None, None, 1)]
    counts = {r.column_name: r.unreadable_rows for r in cleaning.unreadable_values(df, target).collect()}
    assert counts == {"quantity": 1, "code": 2, "wide": 0}
    doubles = spark.createDataFrame([(float("nan"), 2.5), (1.5, 2.0)], "quantity double, code double")
    assert [tuple(r)[:2] for r in cleaning.conform(doubles, target).collect()] == [(None, None), (1.5, 2)]
