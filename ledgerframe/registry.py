"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each callable builds its plan from the driver's tables in full (no row caps,
no sampling); TOP-n limits are kept only where the report itself is a top-n
report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import calendar as C
from .plans import evaluator as EV
from .plans import golden as G
from .plans import measures as M
from .plans import pages as P
from .plans import snapshot as SNAP
from .plans import views as V
from .plans.cleaning import hr as HR
from .plans.cleaning import person as B1
from .plans.cleaning import production as PROD
from .plans.cleaning import purchasing as PURCH
from .plans.cleaning import sales as SALES
from .session import scratch_path
from .sources import tpch
from .plans.reports import customer, forecast, geo, operations, pricing, product, revenue, scorecard


def _g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.golden_from_tables(spark, sf_dir)


def _golden_of(src) -> DataFrame:
    """B18 from the cleaned views over raw tables, person fan-out included."""
    return G.golden(SALES.sales_performance(src), PROD.product_master(src, tpch.AS_OF),
                    SALES.customer_profile(src), B1.clean_person(src))


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B18 after a second refresh: in the first version the last year is missing
    and the quantities of the year before differ."""
    store = SNAP.GoldenStore(spark, scratch_path(spark, "golden-store"))
    full = _g(spark, sf_dir)
    year, qty = F.col("OrderYear"), F.col("OrderQty")
    store.refresh(full.where(year < 2001).withColumn("OrderQty", F.when(year == 2000, qty + 1).otherwise(qty)))
    store.refresh(full, since=2000)
    return store.read()


def _through_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: a statement over the registered golden view."""
    V.register_views(tpch.aw_sources(spark, sf_dir), tpch.AS_OF)
    return spark.sql("SELECT TerritoryRegion, CurrencyCode, COUNT(*) AS Lines, COUNT(DISTINCT SalesOrderID) AS Orders, "
                     "COUNT(DISTINCT CustomerEmail) AS Emails, SUM(OrderQty) AS Quantity "
                     f"FROM {V.GOLDEN_VIEW} GROUP BY TerritoryRegion, CurrencyCode")


def _clean(fn, **kw) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(tpch.aw_sources(spark, sf_dir), **kw)


def _page(page: Callable, dataset: str) -> Callable[[DataFrame], DataFrame]:
    return lambda g: page(g)[dataset]


TIME = ("PMRevenue", "PYRevenue", "PMProfit", "MoMGrowthPct", "YoYGrowthPct", "MoMProfitGrowthPct", "HealthStatus")
MOVING, RETENTION = ("MA3Month", "MA6Month"), ("RetentionRate", "RepeatCustomerPct", "DaysSinceLastOrder")

# Queries over the golden record: name -> callable(golden DataFrame).
GOLDEN_QUERIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "d1_1": revenue.revenue_trend,
    "d1_2": revenue.margin_by_dimension,
    "d1_3": revenue.discount_impact,
    "d2_1": customer.rfm,
    "d2_2": customer.cohort_retention,
    "d2_3": lambda g: customer.churn_risk(g, tpch.AS_OF),
    "d3_1": product.bcg_matrix,
    "d3_2": product.product_affinity,
    "d3_3": product.product_lifecycle,
    "d4_1": geo.geo_performance,
    "d4_2": geo.channel_comparison,
    "d5_1": pricing.price_sensitivity,
    "d5_2": pricing.promotion_effectiveness,
    "d6_1": lambda g: operations.status_fulfilment(g, tpch.AS_OF),
    "d6_2": operations.anomaly_detection,
    "d7_1": forecast.forecast_trend,
    "d8_1": scorecard.health_scorecard,
    "d1_1_all": lambda g: revenue.revenue_trend(g, top=None),
    "d1_2_all": lambda g: revenue.margin_by_dimension(g, top=None),
    "d1_3_all": lambda g: revenue.discount_impact(g, top=None),
    "d2_1_all": lambda g: customer.rfm(g, top=None),
    "d2_2_all": lambda g: customer.cohort_retention(g, top=None),
    "d2_3_all": lambda g: customer.churn_risk(g, tpch.AS_OF, top=None),
    "d3_2_all": lambda g: product.product_affinity(g, top=None),
    "cal": C.date_table,
    "m_core": lambda g: M.core_measures(g, by=["CategoryName", "TerritoryRegion"]),
    "m_time": M.time_intelligence,
    "m_time_category": lambda g: M.time_intelligence(g, by=["CategoryName"]),
    "m_time_year": lambda g: M.time_intelligence(g, grain="year"),
    "m_ma": M.moving_averages,
    "m_ma_year": lambda g: M.moving_averages(g, grain="year"),
    "m_customer": M.customer_measures,
    "m_rfm": M.rfm_columns,
    "m_ltv": lambda g: M.customer_ltv(g, by=["CustomerSegment", "CategoryName"]),
    "m_product": lambda g: M.product_measures(g, by=["CategoryName"]),
    "m_pareto": lambda g: M.pareto(g, by=["CategoryName"]),
    "m_lifecycle": M.lifecycle_stage,
    "m_ops": lambda g: M.operations_measures(g, by=["TerritoryName"]),
    "m_buckets": M.bucket_columns,
    "m_anomaly": lambda g: M.anomaly_measures(g, by=["CategoryName"]),
    "m_forecast": M.forecast_measures,
    "m_scenario": M.scenario_card,
    "m_scenario_region": lambda g: M.scenario_card(g, by=["TerritoryRegion"]),
    "m_season": M.seasonal_index,
    "m_weekpart": M.weekpart_revenue,
    "m_territory": M.territory_growth_rank,
    "m_time_years": lambda g: M.time_intelligence(g, fixed_years=(1996, 1997, 1998, 1999)),
    "m_ship_role": lambda g: M.time_intelligence(g, date_role="ship"),
    "m_eval_category": lambda g: EV.evaluate(
        g, ["TotalRevenue", "AvgOrderValue", "OrderFulfillmentRate", "AlertCritical", "ParetoRatio"], ["CategoryName"]),
    "m_eval_segment_year": lambda g: EV.evaluate(
        g, ["TotalRevenue", "TotalOrders", "YoYGrowthPct", "MA3Month", "WeekendRevenue"], ["CustomerSegment", "Year"]),
    "m_eval_region_month": lambda g: EV.evaluate(
        g, ["TotalRevenue", "MoMGrowthPct", "RetentionRate", "RepeatCustomerPct", "MA6Month", "TrendDirection",
            "SeasonalIndex"], ["TerritoryRegion", "Year", "Month"], where="IsOnlineOrder"),
    "m_eval_quarter": lambda g: EV.evaluate(
        g, ["TotalRevenue", "TotalOrders", *TIME, *MOVING, *RETENTION], ["TerritoryRegion", "Year", "Quarter"]),
    "m_eval_day": lambda g: EV.evaluate(
        g, ["TotalRevenue", "TotalOrders", "PMRevenue", "PYRevenue", "MoMGrowthPct", "YoYGrowthPct", "HealthStatus", *MOVING,
            "Revenue1997"], ["CustomerType", "Date"]),
    "m_eval_retention_year": lambda g: EV.evaluate(g, ["TotalCustomers", *RETENTION], ["CustomerType", "Year"]),
    "m_eval_retention_month": lambda g: EV.evaluate(g, ["TotalCustomers", *RETENTION], ["Year", "Month"]),
    # filter context: ALLEXCEPT, ALL, TOPN over ALL, RANKX over ALL, ALLSELECTED
    "m_ctx_segment_quarter": lambda g: EV.evaluate(
        g, ["TotalRevenue", "CustomerLTV", "RevenueZScore", "RevenueVariance", "SelectionSharePct", "Top20ProductsRevenue", "ProductCount"],
        ["CustomerSegment", "Year", "Quarter"]),
    "m_ctx_product_year": lambda g: EV.evaluate(
        g, ["TotalRevenue", "ProductContributionPct", "ProductVelocity", "CustomerLTV", "RevenueZScore", "RevenueVariance"],
        ["CategoryName", "ProductName", "Year"]),
    "m_ctx_product_color": lambda g: EV.evaluate(
        g, ["ProductContributionPct", "ProductVelocity", "RevenueZScore"], ["ProductColor", "ProductName"]),
    "m_ctx_territory_quarter": lambda g: EV.evaluate(
        g, ["TotalRevenue", "YoYGrowthPct", "TerritoryGrowthRank"], ["TerritoryName", "Year", "Quarter"]),
    "m_ctx_type_territory_year": lambda g: EV.evaluate(
        g, ["TotalRevenue", "TerritoryGrowthRank", "CustomerLTV"], ["CustomerType", "TerritoryName", "Year"]),
    "m_ctx_type_month": lambda g: EV.evaluate(
        g, ["CustomerLTV", "Top20ProductsRevenue", "ParetoRatio"], ["CustomerType", "Year", "Month"]),
    "page_1": lambda g: P.page_1(g)["kpis"],
    "page_2": P.margin_by_segment,
    "page_3": P.segment_summary,
    "page_4": P.pareto_curve,
    "page_5": P.region_trend,
    "page_6": P.day_of_week,
    "page_7": P.channel_size,
    "page_8": P.z_bands,
    "page_9": P.forecast_6m,
    **{name: _page(page, dataset) for name, (page, dataset) in {
        "g1_category": (P.page_1, "revenue_by_category"), "g1_region": (P.page_1, "revenue_by_region"),
        "g1_heatmap": (P.page_1, "category_month_heatmap"), "g2_discount": (P.page_2, "discount_table"),
        "g2_subcategory": (P.page_2, "margin_by_subcategory"), "g3_matrix": (P.page_3, "rfm_matrix"),
        "g3_top": (P.page_3, "top_customers"), "g3_repeat": (P.page_3, "repeat_customers"),
        "g4_portfolio": (P.page_4, "portfolio"), "g4_stages": (P.page_4, "lifecycle_counts"),
        "g4_color": (P.page_4, "margin_by_color_category"), "g4_top": (P.page_4, "top_products"),
        "g5_matrix": (P.page_5, "territory_year_matrix"),
        "g6_heatmap": (P.page_6, "month_year_heatmap"), "g6_year_month": (P.page_6, "year_month"), "g6_series": (P.page_6, "month_year_series"),
        "g7_daily": (P.page_7, "daily_orders"), "g7_kpis": (P.page_7, "kpis"), "g8_scatter": (P.page_8, "z_scatter"),
        "g8_log": (P.page_8, "anomaly_log"), "g8_kpis": (P.page_8, "kpis"), "g9_volatility": (P.page_9, "volatility"),
        "g9_trend": (P.page_9, "trend_by_category"),
    }.items()},
}

# Queries over the raw tables: name -> callable(spark, sf_dir).
TABLE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_person": _clean(B1.clean_person),
    "clean_product": _clean(PROD.product_master, as_of=tpch.AS_OF),
    "clean_customer": _clean(SALES.customer_profile),
    "clean_sales": _clean(SALES.sales_performance),
    "clean_sales_person": _clean(SALES.sales_person),
    "clean_inventory": _clean(PROD.inventory),
    "clean_work_order": _clean(PROD.work_order),
    "clean_transaction": _clean(PROD.transaction_history),
    "clean_vendor": _clean(PURCH.vendor_master),
    "clean_purchase_orders": _clean(PURCH.purchase_orders),
    "clean_product_vendor": _clean(PURCH.product_vendor),
    "clean_department": _clean(HR.department),
    "clean_employee": _clean(HR.employee, as_of=tpch.AS_OF),
    "clean_department_history": _clean(HR.department_history, as_of=tpch.AS_OF),
    "clean_pay_history": _clean(HR.pay_history),
    "clean_job_candidate": _clean(HR.job_candidate),
    "clean_shift": _clean(HR.shift),
    "golden_generic": lambda spark, sf_dir: _golden_of(tpch.aw_sources(spark, sf_dir)),
    "golden": _g,
    "golden_refresh": _refreshed,
    "views": _through_views,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(TABLE_QUERIES)
QUERIES.update({k: (lambda f: (lambda spark, sf_dir: f(_g(spark, sf_dir))))(f)
                for k, f in GOLDEN_QUERIES.items()})
