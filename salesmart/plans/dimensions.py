"""Builders of the five dimension tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from salesmart.functions.calendar import calendar_columns
from salesmart.functions.cleaning import (
    add_missing_columns, full_name, lenient_date, lenient_flag, lenient_number, with_defaults)
from salesmart.operators.hierarchy import parent_name
from salesmart.operators.keys import number_rows
from salesmart.sources.schemas import RAW_SCHEMAS

# Texts that stand for a missing attribute, and the columns of the
# dimension tables with the raw columns they come from.
UNKNOWN = "Unknown"
NO_SUPERVISOR = "N/A"

SHIPPER_COLUMNS = {
    "shipper_id": "shipperid", "company_name": "companyname", "phone": "phone"}

CUSTOMER_COLUMNS = {
    "customer_id": "customerid", "company_name": "companyname",
    "contact_name": "contactname", "contact_title": "contacttitle",
    "address": "address", "city": "city", "region": "region",
    "postal_code": "postalcode", "country": "country", "phone": "phone", "fax": "fax"}

CATEGORY_COLUMNS = {
    "categoryid": "categoryid", "category_name": "categoryname",
    "category_description": "description"}

SUPPLIER_COLUMNS = {
    "supplierid": "supplierid", "supplier_name": "companyname",
    "supplier_contact_name": "contactname", "supplier_country": "country",
    "supplier_phone": "phone"}

PRODUCT_COLUMNS = {
    "product_id": "productid", "product_name": "productname",
    "category_id": "categoryid", "category_name": "category_name",
    "category_description": "category_description", "supplier_id": "supplierid",
    "supplier_name": "supplier_name", "supplier_contact_name": "supplier_contact_name",
    "supplier_country": "supplier_country", "supplier_phone": "supplier_phone",
    "quantity_per_unit": "quantityperunit", "unit_price": "unitprice",
    "units_in_stock": "unitsinstock", "units_on_order": "unitsonorder",
    "reorder_level": "reorderlevel", "discontinued": "discontinued"}

CUSTOMER_DEFAULTS = {"region": UNKNOWN, "postal_code": UNKNOWN}
EMPLOYEE_DEFAULTS = {"salary": 0.0}
PRODUCT_DEFAULTS = {
    "category_name": UNKNOWN, "supplier_name": UNKNOWN, "supplier_contact_name": UNKNOWN,
    "supplier_country": UNKNOWN, "supplier_phone": UNKNOWN, "units_in_stock": 0,
    "discontinued": False}


def _project(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Select source columns under their target names."""
    return df.select(*[F.col(source).alias(target) for target, source in columns.items()])


def _keyed(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """Put a dense surrogate key, in source-id order, in front.

    The other columns order rows that repeat an id, so the same input always gets
    the same keys.
    """
    order = [id_col, *[c for c in df.columns if c != id_col]]
    return number_rows(df, order, key).select(key, *df.columns)


def build_dim_shipper(shippers: DataFrame) -> DataFrame:
    source = add_missing_columns(shippers, RAW_SCHEMAS["shippers"])
    rows = _project(source, SHIPPER_COLUMNS)
    return _keyed(rows, "shipper_id", "shipper_key")


def build_dim_customer(customers: DataFrame) -> DataFrame:
    source = add_missing_columns(customers, RAW_SCHEMAS["customers"])
    rows = with_defaults(_project(source, CUSTOMER_COLUMNS), CUSTOMER_DEFAULTS)
    return _keyed(rows, "customer_id", "customer_key")


def build_dim_employee(employees: DataFrame) -> DataFrame:
    source = add_missing_columns(employees, RAW_SCHEMAS["employees"])
    rows = source.select(
        F.col("employeeid").alias("employee_id"),
        F.col("lastname").alias("last_name"),
        F.col("firstname").alias("first_name"),
        full_name("firstname", "lastname").alias("full_name"),
        "title",
        F.col("titleofcourtesy").alias("title_of_courtesy"),
        lenient_date(source, "birthdate").alias("birth_date"),
        lenient_date(source, "hiredate").alias("hire_date"),
        "address", "city", "region", "country",
        F.col("homephone").alias("home_phone"),
        F.col("reportsto").alias("reports_to"),
        lenient_number("salary").alias("salary"),
    )
    rows = with_defaults(rows, EMPLOYEE_DEFAULTS)
    keyed = _keyed(rows, "employee_id", "employee_key")
    named = parent_name(
        keyed, "employee_id", "reports_to", "full_name", "employee_key",
        out="reports_to_name", default=NO_SUPERVISOR)
    return named.select(
        *[c for c in keyed.columns if c != "salary"], "reports_to_name", "salary")


def join_product_sources(
    products: DataFrame, categories: DataFrame, suppliers: DataFrame
) -> DataFrame:
    """Products with category and supplier attributes; unmatched ones get the defaults."""
    items = add_missing_columns(products, RAW_SCHEMAS["products"])
    groups = _project(
        add_missing_columns(categories, RAW_SCHEMAS["categories"]), CATEGORY_COLUMNS
    ).filter(F.col("categoryid").isNotNull())
    vendors = _project(
        add_missing_columns(suppliers, RAW_SCHEMAS["suppliers"]), SUPPLIER_COLUMNS
    ).filter(F.col("supplierid").isNotNull())
    joined = items.join(groups, "categoryid", "left").join(vendors, "supplierid", "left")
    rows = _project(joined, PRODUCT_COLUMNS)
    flagged = rows.withColumn("discontinued", lenient_flag(rows, "discontinued"))
    return with_defaults(flagged, PRODUCT_DEFAULTS)


def build_dim_product(
    products: DataFrame, categories: DataFrame, suppliers: DataFrame
) -> DataFrame:
    rows = join_product_sources(products, categories, suppliers)
    return _keyed(rows, "product_id", "product_key")


def date_spine(sources: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Every distinct readable date of the given columns, one row each.

    Partial aggregation removes repeats before the shuffle, so what moves is at
    most one row per date and task.
    """
    days = [
        df.select(lenient_date(df, column).alias("full_date")) for df, column in sources
    ]
    return reduce(DataFrame.unionAll, days).filter(F.col("full_date").isNotNull()).distinct()


def build_dim_date(sources: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    return date_spine(sources).withColumns(calendar_columns(F.col("full_date")))


def order_date_sources(
    orders: DataFrame, order_details: DataFrame
) -> list[tuple[DataFrame, str]]:
    """Order and ship dates, on whichever of the two tables carries them."""
    return [
        (df, column)
        for df in (orders, order_details)
        for column in ("orderdate", "shippeddate")
        if column in df.columns
    ]


