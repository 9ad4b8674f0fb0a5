"""Read the raw tables of a data folder."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from salesmart.functions.cleaning import conform
from salesmart.sources.quoted_csv import read_quoted_csv
from salesmart.sources.schemas import RAW_SCHEMAS, SOURCE_FILES

#: Tables that grow with the business and have no free text.
LINE_TABLES = ("orders", "order_details")


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file of a path; 0 if there is none."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(files) or []
    below = [status for top in found for status in (
        system.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return max((status.getLen() for status in below), default=0)


def split_bytes(spark: SparkSession) -> int:
    """The most bytes that one task reads of a file."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def read_csv_table(
    spark: SparkSession, path: str, name: str, multi_line: bool | None = None
) -> DataFrame:
    """One CSV table with a header, matched to its schema by column name.

    Every field is read as text (the header supplies the names, so no inference
    scan runs), null tokens are removed, and values are cast leniently.
    ``multi_line`` allows quoted line breaks; by default all tables but those of LINE_TABLES,
    whose fields are codes, numbers and dates, may have them. The parser takes such a file whole,
    so files beyond one split are cut into records first, in parallel.
    """
    if multi_line is None:
        multi_line = name not in LINE_TABLES
    if multi_line and largest_file(spark, path) > split_bytes(spark):
        return conform(read_quoted_csv(spark, path), RAW_SCHEMAS[name])
    text = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return conform(text, RAW_SCHEMAS[name])


def read_parquet_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return conform(spark.read.parquet(path), RAW_SCHEMAS[name])


def extract(
    spark: SparkSession,
    folder: str,
    files: Mapping[str, str] = SOURCE_FILES,
    fmt: str = "csv",
    multi_line: bool | None = None,
) -> dict[str, DataFrame]:
    """All raw tables of a folder; a missing file raises and stops the run."""
    tables = {}
    for name, file in files.items():
        path = os.path.join(folder, file)
        if fmt == "csv":
            tables[name] = read_csv_table(spark, path, name, multi_line)
        elif fmt == "parquet":
            tables[name] = read_parquet_table(spark, path, name)
        else:
            raise ValueError(f"unknown source format: {fmt}")
    return tables
