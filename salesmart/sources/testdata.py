"""The test tables in the shape of the raw sales tables.

Column stand-ins: order priority acts as the employee who took the order, the
line's supplier as the shipper, the part's size as the product's supplier id,
and the order total as the freight amount copied onto each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _employee_id(priority: str):
    return F.substring(F.col(priority), 1, 1).cast("int")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderid"),
        F.col("o_custkey").alias("customerid"),
        _employee_id("o_orderpriority").alias("employeeid"),
        F.col("o_orderdate").alias("orderdate"),
        F.col("o_totalprice").alias("freight"),
    )


def order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderid"),
        F.col("l_partkey").alias("productid"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unitprice"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_suppkey").alias("shipvia"),
        F.col("l_shipdate").alias("shippeddate"),
    )


def _with_country(df: DataFrame, spark: SparkSession, sf_dir: str, nation_key: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias(nation_key), F.col("n_name").alias("country"))
    return df.join(nation, nation_key, "left")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _with_country(table(spark, sf_dir, "customer"), spark, sf_dir, "c_nationkey")
    return source.select(
        F.col("c_custkey").alias("customerid"),
        F.col("c_name").alias("companyname"),
        F.col("c_mktsegment").alias("contacttitle"),
        "country",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("productid"),
        F.col("p_name").alias("productname"),
        F.col("p_type").alias("categoryid"),
        F.col("p_size").cast("bigint").alias("supplierid"),
        F.col("p_brand").alias("quantityperunit"),
        F.col("p_retailprice").alias("unitprice"),
        F.col("p_size").alias("reorderlevel"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_type").distinct().select(
        F.col("p_type").alias("categoryid"),
        F.col("p_type").alias("categoryname"),
        F.lower("p_type").alias("description"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _with_country(table(spark, sf_dir, "supplier"), spark, sf_dir, "s_nationkey")
    return source.select(
        F.col("s_suppkey").alias("supplierid"),
        F.col("s_name").alias("companyname"),
        "country",
    )


def shippers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("shipperid"), F.col("s_name").alias("companyname"))


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One employee per order priority; dates are the text forms of the order-date range."""
    text_date = "MM/dd/yyyy H:mm"
    per_priority = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.min("o_orderdate").alias("first_day"),
        F.max("o_orderdate").alias("last_day"),
        F.max("o_totalprice").alias("largest"),
    )
    return per_priority.select(
        _employee_id("o_orderpriority").alias("employeeid"),
        F.substring_index("o_orderpriority", "-", -1).alias("lastname"),
        F.lit("Clerk").alias("firstname"),
        F.date_format("first_day", text_date).alias("birthdate"),
        F.date_format("last_day", text_date).alias("hiredate"),
        (_employee_id("o_orderpriority") - 1).alias("reportsto"),
        F.col("largest").cast("string").alias("salary"),
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        builder.__name__: builder(spark, sf_dir)
        for builder in (
            orders, order_details, products, categories, customers, employees,
            shippers, suppliers)
    }
