import datetime

import pytest

from salesmart.plans import dashboard, marts, report, retention, targets
from salesmart.plans.sales import sales


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_financial_trend(star):
    assert rows(marts.financial_trend(star, 1996)) == [
        (1996, 1, "January", 321.12, 2), (1996, 3, "March", 329.0, 4)]


def test_category_filter_takes_names_as_values(star):
    assert rows(marts.financial_trend(star, 1996, ["Chef's Choice"])) == [
        (1996, 1, "January", 0.12, 1), (1996, 3, "March", 320.0, 2)]
    assert rows(marts.financial_trend(star, 1996, ["Unknown"])) == [
        (1996, 3, "March", 7.0, 1)]
    assert rows(marts.financial_trend(star, 1996, ["x' OR '1'='1"])) == []


def test_no_categories_means_no_filter(star):
    assert rows(marts.geo_performance(star, 1996, [])) == rows(marts.geo_performance(star, 1996))


def test_customers_with_one_name_merge(star):
    got = rows(marts.customer_clv(star, 1996))
    assert [r[:3] for r in got] == [("Alpha", 2, 273.12), ("Beta", 1, 270.0), ("Twin", 3, 107.0)]
    assert [r[3] for r in got] == [273.12 * 1.2, 270.0 * 1.2, 107.0 * 1.2]


def test_missing_country_is_a_group(star):
    assert rows(marts.geo_performance(star, 1996)) == [("Chile", 543.12, 3), (None, 107.0, 3)]


def test_products_with_one_name_merge(star):
    assert rows(marts.product_performance(star, 1996)) == [
        ("Tea", "Drinks", 323.0, 7), ("Cake", "Chef's Choice", 320.12, 3),
        ("Rope", "Unknown", 7.0, 1)]
    assert rows(marts.product_performance(star, 1996, ["Drinks"])) == [
        ("Tea", "Drinks", 323.0, 7)]


def test_categories(star):
    by_category = marts.category_performance(star, 1996)
    assert rows(by_category) == [
        ("Drinks", 323.0), ("Chef's Choice", 320.12), ("Unknown", 7.0)]
    shares = rows(marts.category_share(by_category))
    assert [s for _, _, s in shares] == [
        round(v / 650.12, 6) for v in (323.0, 320.12, 7.0)]
    assert sum(s for _, _, s in shares) == pytest.approx(1, abs=3e-6)


def test_totals_agree_across_marts(star):
    trend = sum(r[3] for r in rows(marts.financial_trend(star, 1996)))
    for mart, column in (
            (marts.customer_clv, 2), (marts.geo_performance, 1),
            (marts.category_performance, 1), (marts.product_performance, 2)):
        assert sum(r[column] for r in rows(mart(star, 1996))) == pytest.approx(trend)


def test_all_time_and_quarterly(star):
    assert rows(marts.customer_purchase_value(star)) == [
        ("Beta", 290.0), ("Alpha", 283.12), ("Twin", 107.0)]
    assert rows(marts.quarterly_customer_orders(star)) == [
        (1995, 4, "Alpha", 1, 10.0), (1995, 4, "Beta", 1, 20.0),
        (1996, 1, "Twin", 3, 107.0), (1996, 1, "Alpha", 2, 273.12), (1996, 1, "Beta", 1, 270.0)]
    assert len(rows(marts.quarterly_customer_orders(star, rows=2))) == 2


def test_top_products_break_ties_by_name(spark):
    tied = spark.createDataFrame(
        [(f"p{i:02d}", "c", 5.0, 1) for i in range(30)],
        "product_name string, category_name string, total_revenue double, total_sold long")
    top = rows(marts.top_products(tied.repartition(7), 20))
    assert [r[0] for r in top] == [f"p{i:02d}" for i in range(20)]


def test_dimension_lists(star):
    assert rows(marts.distinct_years(star)) == [(1997,), (1996,), (1995,)]
    assert rows(marts.distinct_categories(star)) == [("Chef's Choice",), ("Drinks",), ("Unknown",)]
    assert marts.default_year(star) == 1997


def test_retention_gap_and_over_one_hundred(star):
    """January compares with November, the last month with sales; March exceeds 100 %."""
    assert rows(retention.retention_rate(star, 1996)) == [
        (1996, 1, 2, 2, 1, 50.0, 0.0, 50.0), (1996, 3, 2, 4, 1, 150.0, 100.0, -50.0)]


def test_retention_first_month_has_no_rate(star):
    assert rows(retention.retention_rate(star, 1995)) == [
        (1995, 11, None, 2, 2, None, None, None)]


def test_retention_under_a_category_filter(star):
    assert rows(retention.retention_rate(star, 1996, ["Chef's Choice"])) == [
        (1996, 1, 1, 1, 1, 0.0, 0.0, 100.0), (1996, 3, 1, 2, 1, 100.0, 100.0, 0.0)]


def test_first_purchase(star):
    day = datetime.date
    assert sorted(rows(retention.customer_first_purchase(star, 1996))) == [
        (1, day(1995, 11, 5)), (2, day(1995, 11, 7)), (3, day(1996, 1, 9)),
        (4, day(1996, 3, 31))]


def test_yoy_delta_missing_year_counts_as_zero(star):
    assert rows(retention.retention_yoy_delta(star, 1996)) == [(1996, 100.0, None, None)]
    assert rows(retention.retention_yoy_delta(star, 1995)) == [(1995, None, 0.0, None)]
    assert rows(retention.retention_yoy_delta(star, 1997)) == [(1997, 0.0, 100.0, -100.0)]


def scorecard(star, year, target=10):
    return targets.kpi_scorecard(
        marts.financial_trend(star, year), retention.retention_rate(star, year),
        retention.retention_rate(star, year - 1), marts.customer_clv(star, year),
        marts.product_performance(star, year), target)


def test_scorecard(star):
    assert rows(scorecard(star, 1996)) == [
        (650.12, 120.0, 541.8, 100.0, None, 3, "Tea", "Tea")]


def test_scorecard_of_an_empty_year(star):
    assert rows(scorecard(star, 1997, 0)) == [
        (0.0, 0.0, 0.0, 0.0, -100.0, 0, "-", "-")]


def test_target_tables(star):
    trend, rates = marts.financial_trend(star, 1996), retention.retention_rate(star, 1996)
    assert rows(targets.revenue_vs_target(trend, 300)) == [
        (1, "January", 321.12, 300.0, 107.0), (3, "March", 329.0, 300.0, 109.7)]
    assert [r[4] for r in rows(targets.revenue_vs_target(trend, 0))] == [0.0, 0.0]
    assert rows(targets.formatted_targets(trend, 50_000)) == [
        (1, "January", "$321", "$50,000", "0.6%"), (3, "March", "$329", "$50,000", "0.7%")]
    assert [r[3:] for r in rows(targets.formatted_targets(trend, 0))] == [
        ("$0", "0.0%"), ("$0", "0.0%")]
    assert rows(targets.retention_vs_target(rates, 70)) == [
        (1, 50.0, 70.0, -20.0), (3, 150.0, 70.0, 80.0)]
    assert rows(targets.formatted_retention(rates, 70)) == [
        (1, "50.0%", "70%", "-20.0%"), (3, "150.0%", "70%", "+80.0%")]
    assert rows(targets.retention_summary(rates, 70)) == [(1, 12, 30.0, 3)]
    assert rows(targets.revenue_peak_low(trend)) == [(650.12, "March", "January")]


def test_best_month_is_the_first_of_equals_and_skips_null(spark):
    rates = spark.createDataFrame(
        [(1, None), (4, 80.0), (2, 80.0), (3, 70.0)], "month int, retention_rate double")
    assert targets.retention_summary(rates, 75).first().best_month == 2
    empty = targets.retention_summary(rates.filter("month > 9"), 75).first()
    assert (empty.months_on_target, empty.avg_gap, empty.best_month) == (0, None, None)


def test_insights(star):
    got = rows(targets.insights(
        marts.financial_trend(star, 1996), retention.retention_rate(star, 1996),
        marts.product_performance(star, 1996)))
    assert got == [
        ("finance", "Kinerja Keuangan", "$650",
         "Puncak: **March** | Terendah: **January**", "info"),
        ("customer", "Kesehatan Pelanggan", "100.0%", "Retention Kuat (100.0%)", "success"),
        ("product", "Produk Unggulan", "Tea", "Rev: **$323** | Kat: **Drinks**", "success")]


@pytest.mark.parametrize("rate,growth,status,word", [
    (70.01, 0.01, "success", "Kuat"), (70.0, 5.0, "info", "Sedang"), (90.0, 0.0, "info", "Sedang"),
    (50.0, 5.0, "error", "Rendah"), (None, None, "error", "Rendah")])
def test_insight_thresholds(spark, star, rate, growth, status, word):
    rates = spark.createDataFrame([(rate, growth)], "retention_rate double, growth_rate double")
    got = rows(targets.insights(
        marts.financial_trend(star, 1997), rates, marts.product_performance(star, 1997)))
    assert [(r[0], r[4]) for r in got] == [("customer", status)]
    assert word in got[0][3]


def test_no_insights_without_data(star):
    assert rows(targets.insights(
        marts.financial_trend(star, 1997), retention.retention_rate(star, 1999),
        marts.product_performance(star, 1997))) == []


def test_report_tables(spark, star, tmp_path):
    trend, rates = marts.financial_trend(star, 1996), retention.retention_rate(star, 1996)
    products, customers = marts.product_performance(star, 1996), marts.customer_clv(star, 1996)
    tables = report.report_tables(trend, rates, products, customers)
    report.write_report(tables, str(tmp_path))
    report.write_report(tables, str(tmp_path / "json"), fmt="json")
    headline = spark.read.parquet(str(tmp_path / "headline"))
    assert rows(headline) == [("$650", "100.0%", "Tea", 2)]
    best = spark.read.parquet(str(tmp_path / "top_customers"))
    assert sorted(rows(best)) == [("Alpha", 2, "$273"), ("Beta", 1, "$270"), ("Twin", 3, "$107")]
    assert rows(tables["top_products"])[0][0] == "Rope"
    assert spark.read.json(str(tmp_path / "json" / "revenue")).count() == 2


def test_headline_without_data(star):
    empty = report.report_headline(
        marts.financial_trend(star, 1997), retention.retention_rate(star, 1999),
        marts.product_performance(star, 1997))
    assert rows(empty) == [("$0", "0.0%", "-", 0)]


def test_kpi_dispatch(star):
    assert rows(dashboard.kpi(star, "geo_performance", 1996)) == rows(
        marts.geo_performance(star, 1996))
    with pytest.raises(ValueError, match="unknown KPI kind"):
        dashboard.kpi(star, "weather", 1996)


def test_dashboard(star):
    with pytest.raises(ValueError, match="at least one category"):
        dashboard.dashboard_tables(star, [])
    everything = [r[0] for r in rows(marts.distinct_categories(star))]
    page = dashboard.dashboard_tables(star, everything, 1996)
    assert rows(page["category_performance"]) == rows(marts.category_performance(star, 1996))
    assert rows(page["rfm_segment_counts"]) == [("Champions", 1), ("Lost", 1), ("Potential", 1)]
    assert dashboard.selected(star, everything) is None
    assert dashboard.selected(star, everything[:2]) == everything[:2]
    newest = dashboard.dashboard_tables(star)
    assert rows(newest["financial_trend"]) == []
    assert rows(newest["scorecard"])[0][0] == 0.0


def test_star_through_sql(spark, star):
    star.register()
    got = spark.sql("""
        SELECT p.category_name, sum(f.revenue) AS revenue, count(DISTINCT f.order_id) AS orders
        FROM fact_sales f JOIN dim_product p ON f.product_key = p.product_key
        JOIN dim_date d ON f.date_key = d.date_key
        WHERE d.year = :year GROUP BY 1 ORDER BY 2 DESC""", args={"year": 1996})
    assert [(c, float(r), n) for c, r, n in got.collect()] == [
        ("Drinks", 323.0, 3), ("Chef's Choice", 320.12, 3), ("Unknown", 7.0, 1)]


def test_year_filter_needs_no_other_year(star):
    assert {r.order_year for r in sales(star, [1995]).collect()} == {1995}
