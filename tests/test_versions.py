"""Loads become visible at once or not at all, and only once."""

import fixtures
import pytest
from pyspark.sql import functions as F

from salesmart import jobs
from salesmart.plans import etl
from salesmart.plans.etl import EmptyPhase, run_etl
from salesmart.sources import sinks, versions


def contents(spark, root):
    star = sinks.open_warehouse(spark, root)
    return {name: sorted(map(str, df.collect())) for name, df in star.tables().items()}


def changed(raw):
    return raw | {"customers": raw["customers"].withColumn("companyname", F.lit("Other"))}


@pytest.fixture
def built(spark, tmp_path):
    root = str(tmp_path / "w")
    run_etl(spark, fixtures.raw_tables(spark), root, load_id="first")
    return root


@pytest.mark.parametrize("mode", ["overwrite", "append"])
def test_load_killed_between_dimensions_and_fact(spark, built, monkeypatch, mode):
    before = contents(spark, built)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(etl, "write_fact", killed)
    with pytest.raises(KeyboardInterrupt):
        run_etl(spark, changed(fixtures.raw_tables(spark)), built, mode, "second")
    monkeypatch.undo()
    assert contents(spark, built) == before
    assert versions.versions(spark, built) == [1]
    again = run_etl(spark, changed(fixtures.raw_tables(spark)), built, mode, "second")
    assert not again.repeated and versions.versions(spark, built) == [1, 2]


def test_all_orphans_change_nothing(spark, built):
    before = contents(spark, built)
    raw = fixtures.raw_tables(spark)
    strangers = raw["order_details"].withColumn("productid", F.lit(555).cast("bigint"))
    for mode in ("overwrite", "append"):
        with pytest.raises(EmptyPhase):
            run_etl(spark, raw | {"order_details": strangers}, built, mode)
    assert contents(spark, built) == before


def test_load_is_appended_once(spark, built):
    raw = fixtures.raw_tables(spark)
    later = raw | {name: raw[name].where("orderid IN (3, 20)") for name in ("orders", "order_details")}
    first = run_etl(spark, later, built, "append", "later")
    once = contents(spark, built)
    second = run_etl(spark, later, built, "append", "later")
    assert contents(spark, built) == once
    assert (first.repeated, second.repeated) == (False, True)
    assert (second.kept_rows, second.orphans) == (first.kept_rows, first.orphans)
    assert len(once["fact_sales"]) == 13
    other = run_etl(spark, later, built, "append", "another")
    assert not other.repeated and len(contents(spark, built)["fact_sales"]) == 16


def test_overwrite_forgets_earlier_loads(spark, built):
    raw = fixtures.raw_tables(spark)
    run_etl(spark, raw, built, "append", "more")
    run_etl(spark, raw, built, "overwrite", "anew")
    assert versions.manifest(spark, built).loads.keys() == {"anew"}
    assert not run_etl(spark, raw, built, "append", "more").repeated


def test_readers_keep_their_version(spark, built):
    star = sinks.open_warehouse(spark, built)
    run_etl(spark, changed(fixtures.raw_tables(spark)), built)
    assert {r.company_name for r in star.dim_customer.collect()} >= {"Alpha", "Beta"}
    now = sinks.open_warehouse(spark, built)
    assert {r.company_name for r in now.dim_customer.collect()} == {"Other"}
    old = sinks.open_warehouse(spark, built, version=1)
    assert {r.company_name for r in old.dim_customer.collect()} >= {"Alpha", "Beta"}


def test_two_loads_at_once(spark, built):
    """Both began from one version: the second to end is refused, and what it wrote is not seen."""
    one, two = sinks.Load(spark, built, "append"), sinks.Load(spark, built, "append")
    for load in (one, two):
        load.write(load.read("dim_shipper").limit(1), "dim_shipper")
    one.publish("one")
    with pytest.raises(versions.ConflictingLoad):
        two.publish("two")
    assert sinks.read_table(spark, built, "dim_shipper").count() == 3
    assert versions.manifest(spark, built).loads.keys() == {"first", "one"}


def test_vacuum(spark, built, tmp_path):
    raw = fixtures.raw_tables(spark)
    broken = sinks.Load(spark, built)
    broken.write(sinks.read_table(spark, built, "dim_shipper"), "dim_shipper")
    run_etl(spark, raw, built, "append", "more")
    run_etl(spark, raw, built, "overwrite", "anew")
    now = contents(spark, built)
    # The append found no new dimension rows; its empty files count as little as the broken load's.
    assert f"dim_shipper/load={broken.attempt}" in versions.vacuum(spark, built, keep=3)
    assert contents(spark, built) == now and len(contents(spark, built)["fact_sales"]) == 10
    assert sinks.open_warehouse(spark, built, version=2).fact_sales.count() == 20
    deleted = versions.vacuum(spark, built)
    assert "_manifests/1.json" in deleted and any(x.startswith("fact_sales/") for x in deleted)
    assert contents(spark, built) == now
    assert versions.vacuum(spark, built) == []
    assert versions.vacuum(spark, str(tmp_path / "nothing")) == []


def test_nothing_published(spark, tmp_path):
    with pytest.raises(versions.NoVersion):
        sinks.open_warehouse(spark, str(tmp_path))
    with pytest.raises(versions.NoVersion):
        sinks.read_table(spark, str(tmp_path), "dim_date")


def test_audit_of_every_load(spark, built):
    raw = fixtures.raw_tables(spark)
    later = raw | {name: raw[name].where("orderid IN (3, 20)") for name in ("orders", "order_details")}
    for _ in range(2):
        run_etl(spark, later, built, "append", "later")
    audit = {(r.load_id, r.phase, r.name): r.row_count
             for r in sinks.read_table(spark, built, sinks.AUDIT).collect()}
    assert audit["first", "extract", "order_details"] == 17
    assert audit["later", "extract", "order_details"] == 4
    assert audit["first", "transform", "fact_sales"] == 10 and audit["later", "transform", "fact_sales"] == 3
    assert audit["first", "orphans", "customer_key"] == 2 and audit["later", "orphans", "customer_key"] == 1
    assert audit["first", "transform", "dim_customer"] == 5 and audit["later", "transform", "dim_customer"] == 0
    assert len(audit) == 2 * (8 + 7 + 5)


def test_command_line(spark, tmp_path, capsys):
    for name in fixtures.TABLES:
        fixtures.write_csv(tmp_path, name)
    warehouse = str(tmp_path / "warehouse")
    jobs.main(["build", str(tmp_path), warehouse, "--load-id", "day 1"])
    for _ in range(2):
        jobs.main(["build", str(tmp_path), warehouse, "--mode", "append", "--load-id", "day 2"])
    assert capsys.readouterr().out.count("repeated=True") == 1
    assert sinks.read_table(spark, warehouse, "fact_sales").count() == 20
    jobs.main(["vacuum", warehouse])
    assert "_manifests/1.json" in capsys.readouterr().out
