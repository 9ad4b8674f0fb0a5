"""Tables written to the shared work folder to cut lineage.

A stored table survives the loss of executors and keeps one fixed row layout for
every later read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

def work_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it may go once the application ended."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the session's warehouse folder.

    Both are reachable by the driver and all executors, whatever the master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


_scopes: list[list[str]] = []


@contextmanager
def staged_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside once the results that read it are written."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back.

    Inside ``staged_tables`` it is deleted at the end, else with the application's folder.
    """
    path = f"{work_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for paths in _scopes:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
