"""Build the warehouse: raw tables to dimensions to fact, published together."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from salesmart.functions.cleaning import normalize_columns, require
from salesmart.operators.hierarchy import parent_name
from salesmart.operators.keys import drop_orphans, number_rows, orphan_metrics
from salesmart.plans.dimensions import (
    NO_SUPERVISOR, build_dim_customer, build_dim_date, build_dim_employee, build_dim_product,
    build_dim_shipper, order_date_sources)
from salesmart.plans.facts import resolve_keys, with_amounts, with_order_year
from salesmart.sources.schemas import DIMENSION_IDS, DIMENSIONS, FACT, FOREIGN_KEYS, RAW_SCHEMAS
from salesmart.sources.sinks import AUDIT, AUDIT_SCHEMA, Load, Star, open_warehouse, row_counts
from salesmart.sources.versions import manifest


class EmptyPhase(RuntimeError):
    """A phase produced nothing to carry on with."""


@dataclass(frozen=True)
class LoadReport:
    """Which tables were written, and the fact's line counts.

    ``repeated`` tells that the load had been published before and wrote nothing now.
    """

    written: dict[str, bool]
    joined_rows: int
    kept_rows: int
    orphans: dict[str, int]
    repeated: bool = False


def build_dimension(name: str, raw: Mapping[str, DataFrame]) -> DataFrame:
    match name:
        case "dim_shipper":
            return build_dim_shipper(raw["shippers"])
        case "dim_customer":
            return build_dim_customer(raw["customers"])
        case "dim_employee":
            return build_dim_employee(raw["employees"])
        case "dim_product":
            return build_dim_product(raw["products"], raw["categories"], raw["suppliers"])
        case "dim_date":
            return build_dim_date(order_date_sources(raw["orders"], raw["order_details"]))
    raise ValueError(f"unknown dimension: {name}")


def unseen_rows(df: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """The rows of a dimension whose source id the warehouse does not hold yet.

    They get keys above the greatest present one, and one row per id: the first in key order.
    Rows the warehouse holds stay as they are, so keys on the fact keep their meaning.
    """
    id_col, key = DIMENSION_IDS[name]
    ids = known.select(F.col(id_col).alias("known_id")).distinct()
    fresh = df.join(ids, F.col(id_col).eqNullSafe(F.col("known_id")), "left_anti")
    if key is None:
        return fresh
    firsts = fresh.groupBy(id_col).agg(F.min(key).alias(key)).select(key)
    fresh = fresh.join(firsts, key, "left_semi")
    if name == "dim_employee":
        # A new employee's supervisor may have come with an earlier load.
        people = ["employee_id", "full_name", "employee_key"]
        fresh = parent_name(
            fresh.drop("reports_to_name"), "employee_id", "reports_to", "full_name", "employee_key",
            out="reports_to_name", default=NO_SUPERVISOR,
            among=known.select(people).union(fresh.select(people)))
    top = known.agg(F.max(key)).first()[0] or 0
    columns = [c for c in known.columns if c != key]
    numbered = number_rows(fresh.select(columns), [id_col], key)
    return numbered.withColumn(key, F.col(key) + top).select(*known.columns)


def write_dimension(load: Load, name: str, rows: DataFrame) -> int:
    """Write a dimension, of a warehouse that holds it only what is new; returns the rows written."""
    if load.holds(name):
        rows = unseen_rows(rows, load.read(name), name)
    load.write(rows, name)
    written = load.written_rows(name)
    if not written and len(load.tables[name]) > 1:
        load.tables[name].pop()
    return written


def fact_rows(raw: Mapping[str, DataFrame], dims: Mapping[str, DataFrame], audit: Observation) -> DataFrame:
    """The lines whose keys all resolve, as the fact stores them; all lines are counted in ``audit``."""
    resolved = with_order_year(resolve_keys(raw["orders"], raw["order_details"], dims))
    return with_amounts(drop_orphans(resolved.observe(audit, *orphan_metrics(FOREIGN_KEYS)), FOREIGN_KEYS))


def write_fact(load: Load, raw: Mapping[str, DataFrame]) -> dict[str, int]:
    """Write the lines whose keys all resolve; returns all lines, kept lines and lines lost per key.

    The counts are observed in the writing tasks: that costs no pass of its own, and a task
    repeated after a lost executor is counted once.
    """
    dims = {name: load.read(name) for name in DIMENSIONS}
    audit = Observation("fact lines")
    load.write(fact_rows(raw, dims, audit), FACT)
    counts = audit.get
    if counts["kept_rows"] == 0:
        orphans = {key: counts[key] for key in FOREIGN_KEYS}
        raise EmptyPhase(
            f"none of {counts['joined_rows']} order lines resolves all keys: {orphans}")
    return counts


def write_audit(load: Load, load_id: str, raw: Mapping[str, int], dimensions: Mapping[str, int],
                fact: Mapping[str, int]) -> None:
    """Store what the load read, wrote and lost as rows of the audit table."""
    rows = [("extract", name, rows) for name, rows in raw.items()]
    rows += [("transform", name, rows) for name, rows in dimensions.items()]
    rows += [("transform", "order_lines", fact["joined_rows"]), ("transform", FACT, fact["kept_rows"])]
    rows += [("orphans", key, fact[key]) for key in FOREIGN_KEYS]
    audit = load.spark.createDataFrame([(load_id, *row) for row in rows], AUDIT_SCHEMA)
    load.write(audit.coalesce(1), AUDIT)


def known_report(spark: SparkSession, root: str, load_id: str) -> LoadReport:
    """What a load that was published before reported then."""
    return replace(LoadReport(**manifest(spark, root).loads[load_id]), repeated=True)


def run_etl(
    spark: SparkSession, raw: Mapping[str, DataFrame], root: str, mode: str = "overwrite",
    load_id: str | None = None,
) -> LoadReport:
    """Write the five dimensions, then the fact, and publish them as the warehouse's next version.

    The dimensions do not depend on each other and are built side by side. The
    fact's lookups read the dimensions just written, so Spark plans the joins
    from real table sizes and no dimension is computed twice. Failures are raised, not
    skipped, and leave the last version as it was. ``overwrite`` makes a repeated run leave the
    same tables. ``append`` adds to a warehouse: dimension rows of ids it does not hold, dates
    once, and every line of this input once. Ids it holds keep their key and attributes.
    A load under a ``load_id`` that the warehouse's ledger holds writes nothing in ``append`` and
    gives the report of the first time; so a load whose end is unknown can be run again.
    """
    require(raw, RAW_SCHEMAS)
    load = Load(spark, root, mode)
    if load.appends and load_id in load.before.loads:
        return known_report(spark, root, load_id)
    raw = {name: normalize_columns(df) for name, df in raw.items()}
    if raw["orders"].isEmpty() or raw["order_details"].isEmpty():
        raise EmptyPhase("no orders or no order lines to transform")

    with ThreadPoolExecutor(len(DIMENSIONS) + 1) as pool:
        read = pool.submit(
            lambda: {row.table_name: row.row_count for row in row_counts(raw).collect()})
        sizes = dict(zip(DIMENSIONS, pool.map(
            lambda name: write_dimension(load, name, build_dimension(name, raw)), DIMENSIONS)))
    held = load.before.tables if load.appends else {}
    empty = [name for name in DIMENSIONS if not sizes[name] and not held.get(name)]
    if empty:
        raise EmptyPhase(f"empty dimensions: {empty}")

    fact = write_fact(load, raw)
    write_audit(load, load_id or load.attempt, read.result(), sizes, fact)
    report = LoadReport(
        dict.fromkeys([*DIMENSIONS, FACT], True), fact["joined_rows"], fact["kept_rows"],
        {key: fact[key] for key in FOREIGN_KEYS})
    load.publish(load_id, asdict(report))
    return report


def build_warehouse(
    spark: SparkSession, raw: Mapping[str, DataFrame], root: str, mode: str = "overwrite",
    load_id: str | None = None,
) -> Star:
    run_etl(spark, raw, root, mode, load_id)
    return open_warehouse(spark, root)
