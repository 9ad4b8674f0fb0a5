"""Column names, null tokens, missing columns, lenient parsing and defaults."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Source text that means "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

_MONTH = ("(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
          "sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")

# Shapes of accepted date texts (month first, or ISO) and their formats, after
# ``_plain_date_text`` has taken off zones and written years and months in one way.
DATE_FORMATS = {
    r"^\d{1,2}/\d{1,2}/\d{4} +\d{1,2}:\d{2}.*[AaPp][Mm]$": "M/d/yyyy h:mm[:ss] a",
    r"^\d{1,2}/\d{1,2}/\d{4}": "M/d/yyyy[ H:mm[:ss]]",
    r"^\d{4}-\d{1,2}-\d{1,2}T": "yyyy-M-d'T'H:mm[:ss[.SSSSSSSSS]]",
    r"^\d{4}-\d{1,2}-\d{1,2}": "yyyy-M-d[ H:mm[:ss[.SSSSSSSSS]]]",
    r"^\d{4}/\d{1,2}/\d{1,2}": "yyyy/M/d[ H:mm[:ss]]",
    r"^\d{8}$": "yyyyMMdd",
    r"^[A-Za-z]{3} \d": "MMM d yyyy[ H:mm[:ss]]",
    r"^\d{1,2} [A-Za-z]{3} ": "d MMM yyyy[ H:mm[:ss]]",
}

# The two commonest shapes, with times that exist; no year 0.
ISO_DATE = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"
US_DATE = r"^(\d{1,2})/(\d{1,2})/((?!0000)\d{4})(?: (?:[01]?\d|2[0-3]):[0-5]\d)?$"

# Rewritings that bring a date text to one of the shapes above. Two-digit years
# from 69 on are of the last century.
DATE_REWRITES = (
    (rf"(?i)^(\d.*\d:\d{{2}}\S*?) *(?:Z|UTC|GMT|[+-]\d{{2}}:?\d{{2}})$", "$1"),
    (r"^(?<md>\d{1,2}/\d{1,2}/)(?<yy>69|[7-9]\d)(?=$| )", "${md}19${yy}"),
    (r"^(?<md>\d{1,2}/\d{1,2}/)(?<yy>\d{2})(?=$| )", "${md}20${yy}"),
    (r"(?i)(\d) ?([ap]m)$", "$1 $2"),
    (rf"(?i)^(?<day>\d{{1,2}})[- ]+(?<month>(?={_MONTH}\b)[a-z]{{3}})[a-z]*\.?[-, ]+",
     "${day} ${month} "),
    (rf"(?i)^(?<month>(?={_MONTH}\b)[a-z]{{3}})[a-z]*\.? +(?<day>\d{{1,2}}),? +(?=\d{{4}})",
     "${month} ${day} "),
    (r"^(?<dm>\d{1,2} [A-Za-z]{3} )(?<yy>69|[7-9]\d)(?=$| )", "${dm}19${yy}"),
    (r"^(?<dm>\d{1,2} [A-Za-z]{3} )(?<yy>\d{2})(?=$| )", "${dm}20${yy}"),
)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def null_if_token(value: Column) -> Column:
    return F.when(value.isin(*NULL_TOKENS), F.lit(None)).otherwise(value)


def clean_null_tokens(df: DataFrame) -> DataFrame:
    """Turn the null tokens into NULL in every string column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: null_if_token(F.col(c)) for c in text}) if text else df


def add_missing_columns(df: DataFrame, required: T.StructType) -> DataFrame:
    """Add each required column the frame lacks, as a typed NULL."""
    missing = {
        f.name: F.lit(None).cast(f.dataType)
        for f in required.fields
        if f.name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project a text frame onto a declared schema; unreadable values become NULL.

    Columns the schema does not name are dropped, absent ones are added.
    """
    named = add_missing_columns(clean_null_tokens(normalize_columns(df)), schema)
    return named.select(*[
        lenient_cast(named, f.name, f.dataType).alias(f.name) for f in schema.fields])


def lenient_cast(df: DataFrame, column: str, target: T.DataType) -> Column:
    """Cast that gives NULL for what the type cannot hold.

    ``10.0`` is readable as a whole number, ``2.5`` is not; NaN means no value.
    """
    source, value = df.schema[column].dataType, F.col(column)
    if isinstance(target, T.IntegralType) and not isinstance(source, T.IntegralType):
        exact = value.try_cast("decimal(38,6)")
        return F.when(exact == F.floor(exact), exact).try_cast(target)
    if isinstance(target, T.FractionalType) and not isinstance(target, T.DecimalType):
        return no_nan(value.try_cast(target))
    return value if source == target else value.try_cast(target)


def no_nan(value: Column) -> Column:
    """NULL for NaN."""
    return F.when(~F.isnan(value), value)


def unreadable_values(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Per column of the schema, how many values other than null tokens become NULL."""
    named = add_missing_columns(clean_null_tokens(normalize_columns(df)), schema)
    lost = named.agg(*[
        F.count_if(F.col(f.name).isNotNull() & lenient_cast(named, f.name, f.dataType).isNull())
        .alias(f.name) for f in schema.fields])
    return lost.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("unreadable_rows"))
        for f in schema.fields])).alias("c")).select("c.*")


def lenient_flag(df: DataFrame, column: str) -> Column:
    """Boolean of a number, a number text or a true/false text."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.coalesce(
            F.col(column).try_cast("boolean"), F.col(column).try_cast("double") != 0)
    return F.col(column).cast("boolean")


def _plain_date_text(value: Column) -> Column:
    for pattern, plain in DATE_REWRITES:
        value = F.regexp_replace(value, pattern, plain)
    return value


def _by_shape(plain: Column) -> Column:
    """Date of a rewritten text; its shape picks the format, as a failed parse costs far more than a match."""
    parsed = F.lit(None).cast("date")
    for shape, pattern in reversed(DATE_FORMATS.items()):
        parsed = F.when(plain.rlike(shape), F.try_to_date(plain, pattern)).otherwise(parsed)
    return parsed


def lenient_date(df: DataFrame, column: str) -> Column:
    """Date of a text, date or timestamp column; text no format accepts gives NULL.

    The date is the one that is written, whatever zone follows it. Texts in the two commonest
    shapes are cast, and texts without a digit are no dates. Any other text is rewritten once:
    as the variable of a function over one element, it is not computed anew in every branch.
    """
    value = F.col(column)
    if not isinstance(df.schema[column].dataType, T.StringType):
        return value.cast("date")
    trimmed = F.trim(value)
    rewritten = F.transform(F.array(_plain_date_text(trimmed)), _by_shape)
    return (
        F.when(trimmed.rlike(ISO_DATE), trimmed.try_cast("date"))
        .when(trimmed.rlike(US_DATE), F.regexp_replace(trimmed, US_DATE, "$3-$1-$2").try_cast("date"))
        .when(trimmed.rlike(r"\d"), F.get(rewritten, F.lit(0))))


def lenient_number(column: str) -> Column:
    """Double of a column; unreadable text and NaN give NULL."""
    value = F.col(column).try_cast("double")
    return F.when(~F.isnan(value), value)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULL by a default, column by column, and mark the columns non-null."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def full_name(first: str, last: str) -> Column:
    """First and last name with a blank; NULL when either part is NULL."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def require(tables: Mapping[str, DataFrame], names: Iterable[str]) -> None:
    """Stop when a needed table was not supplied."""
    absent = [n for n in names if n not in tables]
    if absent:
        raise ValueError(f"missing input tables: {', '.join(absent)}")
