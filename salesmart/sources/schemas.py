"""Raw table schemas, the source registry and the star-schema column order."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "string": T.StringType(),
}


def schema(columns: str) -> T.StructType:
    """Schema of ``name type`` pairs; needs no running session, unlike a DDL parse."""
    fields = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# Columns of the raw tables.
RAW_SCHEMAS: dict[str, T.StructType] = {
    "orders": schema(
        "orderid bigint, customerid string, employeeid bigint, orderdate string, "
        "shippeddate string, shipvia bigint, freight double"),
    "order_details": schema(
        "orderid bigint, productid bigint, unitprice double, quantity double, discount double"),
    "products": schema(
        "productid bigint, productname string, supplierid bigint, categoryid bigint, "
        "quantityperunit string, unitprice double, unitsinstock double, "
        "unitsonorder double, reorderlevel double, discontinued string"),
    "categories": schema("categoryid bigint, categoryname string, description string"),
    "customers": schema(
        "customerid string, companyname string, contactname string, "
        "contacttitle string, address string, city string, region string, "
        "postalcode string, country string, phone string, fax string"),
    "employees": schema(
        "employeeid bigint, lastname string, firstname string, title string, "
        "titleofcourtesy string, birthdate string, hiredate string, address string, "
        "city string, region string, country string, homephone string, "
        "reportsto bigint, salary string"),
    "shippers": schema("shipperid bigint, companyname string, phone string"),
    "suppliers": schema(
        "supplierid bigint, companyname string, contactname string, "
        "contacttitle string, address string, city string, region string, "
        "postalcode string, country string, phone string, fax string, homepage string"),
}

# Logical table name to file name in a data folder.
SOURCE_FILES = {name: f"{name}.csv" for name in RAW_SCHEMAS}

# Warehouse tables in load order, and the columns of the fact.
DIMENSIONS = ("dim_shipper", "dim_customer", "dim_employee", "dim_product", "dim_date")
FACT = "fact_sales"
# Source id and surrogate key of each dimension; a date is its own key.
DIMENSION_IDS = {
    "dim_shipper": ("shipper_id", "shipper_key"), "dim_customer": ("customer_id", "customer_key"),
    "dim_employee": ("employee_id", "employee_key"), "dim_product": ("product_id", "product_key"),
    "dim_date": ("full_date", None)}
STAR_TABLES = DIMENSIONS + (FACT,)

# Columns each key lookup leaves on the fact; a line missing any of them is an orphan.
FOREIGN_KEYS = ("customer_key", "product_key", "date_key", "employee_key", "shipper_key")

FACT_COLUMNS = (
    "order_id", "customer_key", "product_key", "date_key", "employee_key", "shipper_key",
    "unit_price", "quantity", "discount", "total_sales", "revenue", "freight",
)
