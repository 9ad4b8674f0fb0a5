import fixtures

from salesmart import jobs


def test_folder_to_report(spark, tmp_path):
    for name in fixtures.TABLES:
        fixtures.write_csv(tmp_path, name)
    warehouse, out = str(tmp_path / "warehouse"), tmp_path / "out"
    jobs.main(["build", str(tmp_path), warehouse])
    jobs.main(["report", warehouse, str(out / "report"), "--year", "1996"])
    jobs.main(["dashboard", warehouse, str(out / "page"), "--year", "1996",
               "--category", "Drinks", "--format", "json"])
    headline = spark.read.parquet(str(out / "report" / "headline")).first()
    assert headline.total_revenue == "$650"
    trend = spark.read.json(str(out / "page" / "financial_trend"))
    assert sorted(r.total_revenue for r in trend.collect()) == [2.0, 321.0]


def test_newest_year_may_have_no_sales(spark, tmp_path):
    from salesmart.plans.etl import run_etl
    run_etl(spark, fixtures.raw_tables(spark), str(tmp_path / "w"))
    tables = jobs.report_tables(spark, str(tmp_path / "w"), None, None, 50_000, 70)
    assert tables["headline"].first().top_product == "-"


def test_parquet_folder(spark, tmp_path):
    for name in fixtures.TABLES:
        fixtures.text_frame(spark, name).write.parquet(str(tmp_path / name))
    loaded = jobs.build(spark, str(tmp_path), str(tmp_path / "w"), fmt="parquet")
    assert loaded.kept_rows == 10


def test_single_line_csv(spark, tmp_path):
    for name in fixtures.TABLES:
        fixtures.write_csv(tmp_path, name)
    loaded = jobs.build(spark, str(tmp_path), str(tmp_path / "w"), multi_line=False)
    assert loaded.kept_rows == 10
