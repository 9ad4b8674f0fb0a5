"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution that splits skewed join partitions from 64 MB on.

    A hot key compresses well in the shuffle, so Spark's default of 256 MB leaves
    one task with many more rows than the others.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
