"""Order-line fact table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from salesmart.functions.calendar import date_key
from salesmart.functions.cleaning import lenient_date
from salesmart.functions.money import cents_to_decimal, line_cents
from salesmart.operators.keys import drop_orphans, lookup_key
from salesmart.sources.schemas import FACT_COLUMNS, FOREIGN_KEYS

# Source id column, dimension, dimension id column, surrogate key.
KEY_LOOKUPS = (
    ("customerid", "dim_customer", "customer_id", "customer_key"),
    ("productid", "dim_product", "product_id", "product_key"),
    ("employeeid", "dim_employee", "employee_id", "employee_key"),
    ("shipvia", "dim_shipper", "shipper_id", "shipper_key"),
)

# Attributes with few values that lines are filtered by; on the fact they need no join.
CARRIED = {"dim_product": ("category_name",)}

# Line total before and after the copy to the revenue column.
AMOUNTS = ("total_sales", "revenue")


def _with_keys(df: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Resolve every lookup whose source id this table carries."""
    for foreign_id, dim, dim_id, key in KEY_LOOKUPS:
        if foreign_id in df.columns:
            df = lookup_key(df, dims[dim], foreign_id, dim_id, key, CARRIED.get(dim, ()))
    return df


def order_lines(orders: DataFrame, order_details: DataFrame) -> DataFrame:
    """Order headers joined to their lines."""
    return orders.join(order_details, "orderid")


def resolve_keys(
    orders: DataFrame, order_details: DataFrame, dims: Mapping[str, DataFrame]
) -> DataFrame:
    """Order lines in cents with all five keys; a key is NULL where nothing matched.

    Header ids are looked up on the headers, before the lines multiply the rows.
    The date dimension holds every readable order date under its own ``yyyymmdd``
    key, so that key needs no join.
    """
    headers = _with_keys(orders, dims)
    headers = headers.withColumn("date_key", date_key(lenient_date(headers, "orderdate")))
    lines = _with_keys(order_details, dims)
    return (
        order_lines(headers, lines)
        .withColumnsRenamed({"orderid": "order_id", "unitprice": "unit_price"})
        .withColumn("revenue_cents", line_cents(
            F.col("quantity"), F.col("unit_price"), F.col("discount")))
        .select(*[c for c in FACT_COLUMNS if c not in AMOUNTS], "revenue_cents", "category_name")
    )


def with_amounts(fact: DataFrame) -> DataFrame:
    """Add the decimal amounts; done last, so that shuffles carry only the cents."""
    amount = cents_to_decimal(F.col("revenue_cents"))
    rest = [c for c in fact.columns if c not in FACT_COLUMNS]
    return fact.withColumns({c: amount for c in AMOUNTS}).select(*FACT_COLUMNS, *rest)


def with_order_year(fact: DataFrame) -> DataFrame:
    """Add the year that the fact is partitioned by.

    Rows stay in the tasks of the join by order id, whose hash deals every year out evenly. A
    shuffle by year would move the widest rows of the load once more for nothing but fewer files.
    """
    return fact.withColumn("order_year", F.floor(F.col("date_key") / 10000).cast("int"))


def build_fact_sales(
    orders: DataFrame, order_details: DataFrame, dims: Mapping[str, DataFrame]
) -> DataFrame:
    """Lines whose five keys all resolve."""
    return with_amounts(drop_orphans(resolve_keys(orders, order_details, dims), FOREIGN_KEYS))
