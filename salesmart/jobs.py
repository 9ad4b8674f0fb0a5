"""Command line: build the warehouse, write one year's dashboard or report tables.

    python -m salesmart.jobs build DATA WAREHOUSE
    python -m salesmart.jobs dashboard WAREHOUSE OUT --year 1997
    python -m salesmart.jobs report WAREHOUSE OUT --year 1997
    python -m salesmart.jobs vacuum WAREHOUSE

``spark-submit`` takes this file with the same arguments and the package's parent
folder on ``PYTHONPATH``; executors run no Python.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from salesmart.plans import dashboard, marts, report, targets
from salesmart.plans.etl import LoadReport, known_report, run_etl
from salesmart.session import build_session
from salesmart.sources.readers import extract
from salesmart.sources.schemas import SOURCE_FILES
from salesmart.sources.sinks import open_warehouse
from salesmart.sources.staging import stage, staged_tables
from salesmart.sources.versions import manifest, vacuum


def build(
    spark: SparkSession, data: str, warehouse: str, fmt: str = "csv", mode: str = "overwrite",
    multi_line: bool | None = None, load_id: str | None = None,
) -> LoadReport:
    """Read a data folder and write the star schema.

    An append under a load id that the warehouse knows reads and writes nothing.

    CSV is parsed once and landed as Parquet, since the build reads its inputs
    more than once and each time only some columns.
    """
    if mode == "append" and load_id in manifest(spark, warehouse).loads:
        return known_report(spark, warehouse, load_id)
    if fmt == "csv":
        text = extract(spark, data, multi_line=multi_line)
        raw = {name: stage(df, f"raw-{name}") for name, df in text.items()}
    else:
        raw = extract(spark, data, {name: name for name in SOURCE_FILES}, fmt)
    return run_etl(spark, raw, warehouse, mode, load_id)


def page_tables(
    spark: SparkSession, warehouse: str, year: int | None, categories: Sequence[str] | None,
    monthly_target: float, retention_target: float,
) -> dict[str, DataFrame]:
    return dashboard.dashboard_tables(
        open_warehouse(spark, warehouse), categories, year, monthly_target, retention_target)


def report_tables(
    spark: SparkSession, warehouse: str, year: int | None, categories: Sequence[str] | None,
    monthly_target: float, retention_target: float,
) -> dict[str, DataFrame]:
    star = open_warehouse(spark, warehouse)
    categories = dashboard.selected(star, categories)
    year = marts.default_year(star) if year is None else year
    needed = ("financial_trend", "retention_rate", "product_performance", "customer_clv")
    return report.report_tables(
        *[stage(dashboard.kpi(star, kind, year, categories), kind) for kind in needed],
        monthly_target, retention_target)


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="salesmart")
    parser.add_argument("--work-folder", help="shared folder for staged tables")
    actions = parser.add_subparsers(dest="action", required=True)
    builder = actions.add_parser("build")
    builder.add_argument("data")
    builder.add_argument("warehouse")
    builder.add_argument("--format", choices=["csv", "parquet"], default="csv")
    builder.add_argument("--mode", choices=["overwrite", "append"], default="overwrite")
    builder.add_argument("--load-id", help="name of this load: appended once, however often it is run")
    builder.add_argument("--single-line", action="store_true",
                         help="no line breaks inside CSV fields of any table: all files are split")
    cleaner = actions.add_parser("vacuum", help="delete what no kept version holds")
    cleaner.add_argument("warehouse")
    cleaner.add_argument("--keep", type=int, default=1, help="versions to keep")
    for action in ("dashboard", "report"):
        writer = actions.add_parser(action)
        writer.add_argument("warehouse")
        writer.add_argument("out")
        writer.add_argument("--year", type=int)
        writer.add_argument("--category", action="append", help="repeatable; default all")
        writer.add_argument("--monthly-target", type=float,
                            default=targets.DEFAULT_MONTHLY_REVENUE)
        writer.add_argument("--retention-target", type=int, default=targets.DEFAULT_RETENTION)
        writer.add_argument("--format", choices=["parquet", "json"], default="parquet")
    args = parser.parse_args(arguments)

    settings = {"spark.checkpoint.dir": args.work_folder} if args.work_folder else {}
    spark = build_session("salesmart", **settings)
    with staged_tables(spark):
        if args.action == "build":
            print(build(
                spark, args.data, args.warehouse, args.format, args.mode,
                False if args.single_line else None, args.load_id))
            return
        if args.action == "vacuum":
            print(*vacuum(spark, args.warehouse, args.keep), sep="\n")
            return
        tables = page_tables if args.action == "dashboard" else report_tables
        report.write_report(
            tables(spark, args.warehouse, args.year, args.category, args.monthly_target,
                   args.retention_target),
            args.out, args.format)


if __name__ == "__main__":
    main()
