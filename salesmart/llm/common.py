"""Helpers shared by the operators of this package."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from salesmart.llm import sharedfs
from salesmart.sources.staging import work_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is; texts of ASCII alone take the quick built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def key_remainder(column: str, divisor: int) -> Column:
    """crc32 of a key's decimal text, modulo ``divisor``; a null key counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text) % divisor


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    folder = sharedfs.make_folder(f"{work_folder(spark)}/package")
    sharedfs.write_bytes(f"{folder}/{package.name}.zip", archive.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/{package.name}.zip")
    _shipped.add(application)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[Iterable[tuple]], Iterable[tuple]]],
             chunk: int = 256) -> DataFrame:
    """Apply a row generator to the rows of each task.

    ``make`` runs once per task and returns a function from an iterator of input tuples
    to an iterator of output tuples. Rows go out in record batches of ``chunk`` rows, so
    memory holds one input batch and one output chunk.
    """
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        rows: list[tuple] = []
        for row in work(arrow_rows(batches)):
            rows.append(row)
            if len(rows) == chunk:
                yield to_batch(rows, out)
                rows = []
        if rows:
            yield to_batch(rows, out)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of record batches as tuples, a few hundred converted at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, schema, strict=True)],
        schema=schema)
