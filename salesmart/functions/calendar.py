"""Calendar attributes of a date."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def date_key(day: Column) -> Column:
    """``yyyymmdd`` as an integer."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def calendar_columns(day: Column) -> dict[str, Column]:
    """Date-dimension columns; the week starts on Monday and week numbers are ISO."""
    weekday = F.weekday(day)
    return {
        "date_key": date_key(day),
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "day": F.dayofmonth(day),
        "day_of_week": weekday + 1,
        "day_name": F.date_format(day, "EEEE"),
        "week_of_year": F.weekofyear(day),
        "is_weekend": weekday >= 5,
        "is_holiday": F.lit(False),
    }
