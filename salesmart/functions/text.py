"""Number texts and shortened labels for reports.

``format_number`` rounds half to even, as the report formats require;
``format_string`` would round half up.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MISSING_NUMBER = "nan"


def _number(value: Column, pattern: str) -> Column:
    return F.coalesce(
        F.call_function("format_number", value, F.lit(pattern)), F.lit(MISSING_NUMBER))


def money_text(value: Column) -> Column:
    """``$1,234``"""
    return F.concat(F.lit("$"), _number(value, "#,##0"))


def percent_text(value: Column) -> Column:
    """``12.3%``"""
    return F.concat(_number(value, "0.0"), F.lit("%"))


def signed_percent_text(value: Column) -> Column:
    """``+1.2%``"""
    return F.concat(_number(value, "+0.0;-0.0"), F.lit("%"))


def shorten(value: Column, longer_than: int, keep: int) -> Column:
    """Keep the first characters and add three dots when a text is too long."""
    cut = F.concat(F.substring(value, 1, keep), F.lit("..."))
    return F.when(F.length(value) > longer_than, cut).otherwise(value)


# Fixed values: (longest text left alone, characters kept) per place of use.
LABEL_LIMITS = {
    "report": (15, 12),
    "scorecard": (15, 15),
    "insight": (25, 25),
    "table": (25, 22),
}


def label(value: Column, place: str) -> Column:
    return shorten(value, *LABEL_LIMITS[place])
