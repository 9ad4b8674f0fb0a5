"""One call per KPI kind, and all the tables of a dashboard page."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from salesmart.plans import marts, report, retention, rfm, targets
from salesmart.sources.sinks import Star
from salesmart.sources.staging import stage

KPI_KINDS: dict[str, Callable[..., DataFrame]] = {
    "financial_trend": marts.financial_trend,
    "retention_rate": retention.retention_rate,
    "customer_clv": marts.customer_clv,
    "product_performance": marts.product_performance,
    "category_performance": marts.category_performance,
    "geo_performance": marts.geo_performance,
    "rfm_raw_data": marts.rfm_raw,
}


def kpi(
    star: Star, kind: str, year: int, categories: Sequence[str] | None = None
) -> DataFrame:
    """The mart of a kind; no categories means no category filter."""
    if kind not in KPI_KINDS:
        raise ValueError(f"unknown KPI kind: {kind}")
    return KPI_KINDS[kind](star, year, categories)


def selected(star: Star, categories: Sequence[str] | None) -> Sequence[str] | None:
    """The category filter a selection needs: none when it covers every product.

    No selection argument means all categories; an empty selection is an error.
    The check stops at the first product outside the selection.
    """
    if categories is None:
        return None
    if not categories:
        raise ValueError("select at least one category")
    outside = star.dim_product.filter(~F.col("category_name").isin(list(categories)))
    return None if outside.isEmpty() else categories


def dashboard_tables(
    star: Star,
    categories: Sequence[str] | None = None,
    year: int | None = None,
    monthly_target: float = targets.DEFAULT_MONTHLY_REVENUE,
    retention_target: float = targets.DEFAULT_RETENTION,
) -> dict[str, DataFrame]:
    """Every table a page shows, for the newest year unless one is given.

    Each mart is computed once and stored, and all tables are made from the stored marts: the
    fact is read eight times, however many tables there are. Call this and write the tables
    inside ``staged_tables`` to have the stored marts deleted after it.
    """
    categories = selected(star, categories)
    if year is None:
        year = marts.default_year(star)
    if year is None:
        raise ValueError("the warehouse holds no dates")
    page = {kind: stage(kpi(star, kind, year, categories), kind) for kind in KPI_KINDS}
    trend, rates = page["financial_trend"], page["retention_rate"]
    products, customers = page["product_performance"], page["customer_clv"]
    before = stage(kpi(star, "retention_rate", year - 1, categories), "retention_before")
    segments = stage(rfm.rfm_segments(page["rfm_raw_data"], year), "segments")
    return page | {
        "scorecard": targets.kpi_scorecard(
            trend, rates, before, customers, products, monthly_target),
        "insights": targets.insights(trend, rates, products),
        "category_share": marts.category_share(page["category_performance"]),
        "revenue_vs_target": targets.revenue_vs_target(trend, monthly_target),
        "retention_vs_target": targets.retention_vs_target(rates, retention_target),
        "retention_summary": targets.retention_summary(rates, retention_target),
        "rfm_segment_counts": rfm.rfm_segment_counts(segments),
        "rfm_customer_table": rfm.rfm_customer_table(segments),
        "top_products": report.top15_products(products),
    }
