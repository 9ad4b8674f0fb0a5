import datetime
from decimal import Decimal

import fixtures
import pytest

from salesmart.plans.etl import EmptyPhase, build_dimension, run_etl
from salesmart.sources.schemas import FACT_COLUMNS, STAR_TABLES
from salesmart.sources.sinks import open_warehouse, row_counts


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}


def test_dim_customer(star):
    got = rows_by(star.dim_customer, "customer_id")
    assert [got[c].customer_key for c in ("AAA", "BBB", "CC1", "CC2", "DDD")] == [1, 2, 3, 4, 5]
    assert got["AAA"].region == "Unknown" and got["AAA"].postal_code == "05021"
    assert got["BBB"].region == "South" and got["BBB"].postal_code == "Unknown"
    assert got["CC1"].region == "Unknown" and got["CC1"].country is None
    assert got["AAA"].fax is None


def test_dim_employee(star):
    got = rows_by(star.dim_employee, "employee_id")
    assert got[1].full_name == "Ann Stone" and got[2].full_name is None
    assert got[1].birth_date == datetime.date(1961, 3, 14)
    assert got[1].hire_date == datetime.date(1990, 9, 3)
    assert got[2].birth_date is None and got[2].hire_date == datetime.date(1992, 8, 14)
    assert got[1].salary == 3107.25 and got[2].salary == 0.0
    assert got[1].reports_to_name == got[2].reports_to_name == "N/A"


def test_dim_employee_supervisors(spark):
    raw = fixtures.raw_tables(spark)
    from pyspark.sql import functions as F
    raw["employees"] = raw["employees"].withColumn(
        "reportsto", F.when(F.col("employeeid") == 2, 1).cast("bigint"))
    got = rows_by(build_dimension("dim_employee", raw), "employee_id")
    assert got[2].reports_to_name == "Ann Stone" and got[1].reports_to_name == "N/A"


def test_dim_product(star):
    got = rows_by(star.dim_product, "product_id")
    assert got[1].category_name == "Drinks" and got[1].category_description == "wet, cold"
    assert got[1].supplier_name == "North Farm" and got[1].supplier_country == "Norway"
    assert got[2].supplier_contact_name == "Unknown" and got[2].supplier_phone == "Unknown"
    assert got[3].category_name == got[3].supplier_name == "Unknown"
    assert got[3].category_description is None
    assert (got[1].units_in_stock, got[2].units_in_stock) == (39, 0)
    assert [got[i].discontinued for i in (1, 2, 3)] == [False, True, False]
    assert got[1].unit_price == 18.0


def test_dim_date_holds_observed_days_once(star):
    days = sorted(r.full_date.isoformat() for r in star.dim_date.collect())
    assert days == [
        "1995-11-05", "1995-11-07", "1995-11-20", "1996-01-09", "1996-01-10", "1996-03-01",
        "1996-03-02", "1996-03-31", "1996-04-01", "1997-02-01"]


def test_fact_keeps_resolved_lines_only(star):
    fact = star.fact_sales.collect()
    assert sorted({r.order_id for r in fact}) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert len(fact) == 10
    assert star.fact_sales.columns == [
        *FACT_COLUMNS, "revenue_cents", "category_name", "order_year"]
    third = sorted(r.total_sales for r in fact if r.order_id == 3)
    assert third == [Decimal("0.12"), Decimal("1.00"), Decimal("270.00")]
    assert all(r.revenue == r.total_sales == Decimal(r.revenue_cents) / 100 for r in fact)
    assert all(r.order_year == r.date_key // 10000 for r in fact)


def test_fact_lines_carry_the_order_freight(star):
    assert {r.freight for r in star.fact_sales.filter("order_id = 3").collect()} == {3.0}


def test_report_counts_orphans(spark, tmp_path):
    report = run_etl(spark, fixtures.raw_tables(spark), str(tmp_path))
    assert report.joined_rows == 16 and report.kept_rows == 10
    assert report.orphans == {
        "customer_key": 2, "product_key": 1, "date_key": 1, "employee_key": 1, "shipper_key": 1}
    assert report.written == dict.fromkeys(STAR_TABLES, True)


def test_rerun_leaves_the_same_tables(spark, tmp_path):
    raw = fixtures.raw_tables(spark)

    def counts():
        tables = open_warehouse(spark, str(tmp_path)).tables()
        return {r.table_name: r.row_count for r in row_counts(tables).collect()}

    run_etl(spark, raw, str(tmp_path))
    first = counts()
    run_etl(spark, raw, str(tmp_path))
    assert counts() == first == {
        "dim_shipper": 2, "dim_customer": 5, "dim_employee": 2, "dim_product": 4,
        "dim_date": 10, "fact_sales": 10}


def test_append_keeps_keys_and_writes_each_line_once(spark, tmp_path):
    from pyspark.sql import functions as F
    raw, root = fixtures.raw_tables(spark), str(tmp_path)
    run_etl(spark, raw, root)
    before = {n: set(df.collect()) for n, df in open_warehouse(spark, root).tables().items()}
    run_etl(spark, raw, root, "append")
    star = open_warehouse(spark, root)
    for name in STAR_TABLES[:-1]:
        assert set(getattr(star, name).collect()) == before[name]
        assert getattr(star, name).count() == len(before[name])
    assert star.fact_sales.count() == 20
    assert set(star.fact_sales.collect()) == before["fact_sales"]

    later = dict(raw)
    later["customers"] = raw["customers"].limit(1).withColumns(
        {"customerid": F.lit("NEW"), "companyname": F.lit("New")}).unionAll(
        raw["customers"].filter("customerid = 'AAA'").withColumn("companyname", F.lit("Changed")))
    later["employees"] = raw["employees"].filter("employeeid = 1").withColumns(
        {"employeeid": F.lit(7).cast("bigint"), "reportsto": F.lit(1).cast("bigint")})
    later["orders"] = raw["orders"].filter("orderid = 7").withColumns(
        {"orderid": F.lit(50).cast("bigint"), "customerid": F.lit("NEW"),
         "employeeid": F.lit(7).cast("bigint"), "orderdate": F.lit("1998-02-03")})
    later["order_details"] = raw["order_details"].filter("orderid = 7").withColumn(
        "orderid", F.lit(50).cast("bigint"))
    report = run_etl(spark, later, root, "append")
    assert report.joined_rows == report.kept_rows == 1
    star = open_warehouse(spark, root)
    customers = rows_by(star.dim_customer, "customer_id")
    assert customers["NEW"].customer_key == 6 and customers["AAA"].company_name == "Alpha"
    assert rows_by(star.dim_employee, "employee_id")[7].reports_to_name == "Ann Stone"
    assert star.dim_date.filter("full_date = '1998-02-03'").count() == 1
    new = star.fact_sales.filter("order_id = 50").collect()
    assert len(new) == 1 and new[0].customer_key == 6 and new[0].total_sales == Decimal("2.00")


def test_nan_means_missing(spark, tmp_path):
    from pyspark.sql import functions as F
    raw = fixtures.raw_tables(spark)
    raw["order_details"] = raw["order_details"].withColumn(
        "unitprice", F.when(F.col("orderid") == 7, float("nan")).otherwise(F.col("unitprice")))
    run_etl(spark, raw, str(tmp_path))
    fact = rows_by(open_warehouse(spark, str(tmp_path)).fact_sales, "order_id")
    assert fact[7].total_sales is None and fact[8].total_sales == Decimal("50.00")


def test_fact_is_partitioned_by_order_year(spark, tmp_path):
    run_etl(spark, fixtures.raw_tables(spark), str(tmp_path))
    [load] = (tmp_path / "fact_sales").iterdir()
    years = sorted(p.name for p in load.iterdir() if p.is_dir())
    assert years == ["order_year=1995", "order_year=1996"]


def test_empty_or_missing_input_aborts(spark, tmp_path):
    raw = fixtures.raw_tables(spark)
    with pytest.raises(ValueError, match="missing input tables: orders"):
        run_etl(spark, {k: v for k, v in raw.items() if k != "orders"}, str(tmp_path))
    with pytest.raises(EmptyPhase):
        run_etl(spark, raw | {"orders": raw["orders"].limit(0)}, str(tmp_path))
    with pytest.raises(EmptyPhase, match="dim_customer"):
        run_etl(spark, raw | {"customers": raw["customers"].limit(0)}, str(tmp_path / "w"))


def test_no_line_left_aborts_with_the_counts(spark, tmp_path):
    from pyspark.sql import functions as F
    raw = fixtures.raw_tables(spark)
    lines = raw["order_details"]
    strangers = lines.withColumn("productid", F.lit(555).cast("bigint"))
    with pytest.raises(EmptyPhase, match="none of 16 order lines.*'product_key': 16"):
        run_etl(spark, raw | {"order_details": strangers}, str(tmp_path / "a"))
    headless = lines.withColumn("orderid", F.lit(555).cast("bigint"))
    with pytest.raises(EmptyPhase, match="none of 0 order lines"):
        run_etl(spark, raw | {"order_details": headless}, str(tmp_path / "b"))


def test_unknown_dimension(spark):
    with pytest.raises(ValueError, match="unknown dimension"):
        build_dimension("dim_moon", {})
