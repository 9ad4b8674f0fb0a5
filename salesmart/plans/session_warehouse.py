"""One warehouse per input folder, way of building and Spark application.

Marts read the star schema, so it is built on first use into the shared work
folder and opened again for every later mart of the same application.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from salesmart.plans.etl import run_etl
from salesmart.sources.sinks import Star, open_warehouse
from salesmart.sources.staging import work_folder
from salesmart.sources.testdata import raw_tables

Build = Callable[[SparkSession, str, str], None]

_roots: dict[tuple, str] = {}
_open: dict[str, tuple[SparkSession, Star]] = {}
_building = threading.Lock()

# What a status says besides path, size and time of a file; reading changes the access time.
_UNSTABLE = re.compile(r"access_time=\d+")


def _state(spark: SparkSession, folder: str) -> tuple:
    """Size and number of a folder's files, and path, size and time of each table in it.

    Another state is another build. The files are counted inside the JVM; a call through the gateway
    is made per table, not per file.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tables = sorted(_UNSTABLE.sub("", status.toString()) for status in system.listStatus(path))
    return system.getContentSummary(path).toString(), *tables


def build_once(spark: SparkSession, sf_dir: str, root: str) -> None:
    run_etl(spark, raw_tables(spark, sf_dir), root, load_id="all")


def warehouse_root(spark: SparkSession, sf_dir: str, build: Build = build_once) -> str:
    """The folder of the warehouse that ``build`` makes of a folder's tables."""
    key = (spark.sparkContext.applicationId, build.__name__, sf_dir.rstrip("/"), _state(spark, sf_dir))
    with _building:
        if key not in _roots:
            root = f"{work_folder(spark)}/warehouse-{uuid.uuid4().hex}"
            build(spark, sf_dir, root)
            _roots[key] = root
        return _roots[key]


def session_warehouse(spark: SparkSession, sf_dir: str, build: Build = build_once) -> Star:
    """The star schema of a folder, bound to the given session and its settings."""
    root = warehouse_root(spark, sf_dir, build)
    with _building:
        session, star = _open.get(root, (None, None))
        if session is not spark:
            star = open_warehouse(spark, root)
            _open[root] = spark, star
        return star
