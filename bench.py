"""Time the warehouse build and every mart; print one JSON line.

Environment: BENCH_SF_DIR (folder of the tables), BENCH_CPUS (local cores),
BENCH_RUNS (timed runs per query after one warm-up run; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import time
import uuid

from salesmart.plans.etl import run_etl
from salesmart.registry import QUERIES
from salesmart.session import build_session
from salesmart.sources.staging import work_folder
from salesmart.sources.testdata import raw_tables


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    def build() -> None:
        run_etl(spark, raw_tables(spark, sf_dir), f"{work_folder(spark)}/bench-{uuid.uuid4().hex}")

    first_build = timed(build)
    times = {"warehouse_build": timed(build)}
    for name, query in QUERIES.items():
        def run() -> None:
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        times[name] = statistics.median(timed(run) for _ in range(runs))
    print(json.dumps({
        "metric": "warehouse build plus median time of every query, warm",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(seconds, 3) for name, seconds in times.items()},
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "first_build_sec": round(first_build, 3),
        "cpus": int(cpus),
        "spark": spark.version,
        "driver_memory": spark.conf.get("spark.driver.memory", ""),
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
