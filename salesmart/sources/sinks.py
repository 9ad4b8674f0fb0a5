"""Write and open the warehouse tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from salesmart.sources import versions
from salesmart.sources.schemas import FACT, STAR_TABLES

#: The table of what every load read and wrote.
AUDIT = "load_audit"
AUDIT_SCHEMA = "load_id string, phase string, name string, row_count bigint"


@dataclass(frozen=True)
class Star:
    """The star schema as DataFrames."""

    dim_shipper: DataFrame
    dim_customer: DataFrame
    dim_employee: DataFrame
    dim_product: DataFrame
    dim_date: DataFrame
    fact_sales: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register(self) -> None:
        """Make the tables visible to ``spark.sql`` under their own names."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)


class Load:
    """Tables written together: they become a version of the warehouse at once, or not at all.

    ``overwrite`` starts from nothing, ``append`` from what the last version holds.
    """

    def __init__(self, spark: SparkSession, root: str, mode: str = "overwrite"):
        self.spark, self.root = spark, root
        self.before = versions.manifest(spark, root)
        self.appends = mode == "append"
        self.attempt = versions.new_attempt()
        self.tables = {name: list(attempts) for name, attempts in self.before.tables.items()} \
            if self.appends else {}

    def holds(self, name: str) -> bool:
        return bool(self.tables.get(name))

    def read(self, name: str) -> DataFrame:
        """A table as this load leaves it, as far as it has come."""
        return versions.read_attempts(self.spark, self.root, name, self.tables.get(name, []))

    def write(self, df: DataFrame, name: str) -> None:
        """Write rows of a table; the fact is partitioned by order year."""
        writer = df.write.option("compression", "zstd")
        if name == FACT:
            writer = writer.partitionBy("order_year")
        writer.parquet(versions.attempt_path(self.root, name, self.attempt))
        self.tables[name] = [*self.tables.get(name, []), self.attempt]

    def written_rows(self, name: str) -> int:
        """Rows this load wrote to a table; Parquet answers from its file footers."""
        return versions.read_attempts(self.spark, self.root, name, [self.attempt]).count()

    def publish(self, load_id: str | None = None, report: dict | None = None) -> int:
        """Make what was written visible; returns the version's number."""
        loads = dict(self.before.loads) if self.appends else {}
        loads[load_id or self.attempt] = report or {}
        return versions.publish(self.spark, self.root, self.before, self.tables, loads).version


def load_table(
    df: DataFrame | None, root: str, name: str, mode: str = "overwrite"
) -> bool:
    """Write and publish one table unless there is nothing to write; tells whether it was written.

    Other tables of the warehouse stay as they are.
    """
    if df is None or df.isEmpty():
        return False
    load = Load(df.sparkSession, root, "append")
    if mode == "overwrite":
        load.tables.pop(name, None)
    load.write(df, name)
    load.publish()
    return True


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return versions.read_attempts(
        spark, root, name, versions.manifest(spark, root).tables.get(name, []))


def open_warehouse(spark: SparkSession, root: str, version: int | None = None) -> Star:
    """All tables of one version, by default of the last one published."""
    tables = versions.manifest(spark, root, version).tables
    return Star(**{name: versions.read_attempts(spark, root, name, tables.get(name, []))
                   for name in STAR_TABLES})


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table. Parquet answers from its file footers without reading columns."""
    counts = [
        df.agg(F.count("*").alias("row_count"))
        .select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)
