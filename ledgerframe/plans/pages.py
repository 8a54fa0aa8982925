"""Dashboard page datasets (G1-G9): the data behind each page's visuals.

Each ``page_n(g)`` returns ``{dataset name: DataFrame}``; nothing is
rendered.  Datasets reuse the measure layer; per-customer or per-product
attributes are joined to pre-aggregated rows (never to lines).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distinctcount_blank, divide, round_half_up
from ..operators.ranking import global_running_sum
from ..operators.stats import scalar
from . import measures as M
from .calendar import calendar_bounds
from .golden import latest_order_date

REV, PROF = M.REV, M.PROF
TOP_N = 20
Z_BANDS = [(3, "Critical (|Z| > 3)"), (2, "Warning (2-3)")]
Z_BAND_ELSE = "Normal (|Z| <= 2)"
FORECAST_MONTHS = 6


def _select(g: DataFrame, where):
    """Apply the page's slicer selection (a Column predicate or SQL string);
    selection-wide statistics (ALLSELECTED) then refer to the filtered rows."""
    if where is None:
        return g
    return g.where(where if not isinstance(where, str) else F.expr(where))


def _kpi(g: DataFrame, by: list[str]) -> DataFrame:
    return M.core_measures(g, by).select(*by, "TotalRevenue", "TotalProfit", "TotalOrders", "ProfitMarginPct")


def page_1(g: DataFrame, where=None) -> dict[str, DataFrame]:
    """Executive summary."""
    g = _select(g, where)
    heat = (M._dated(g).groupBy("CategoryName").pivot("Month", list(range(1, 13)))
                       .agg(F.sum(REV)))
    return {"kpis": _kpi(g, []), "ma3_trend": M.moving_averages(g).select("Year", "Month", "MA3Month"),
            "revenue_by_category": _kpi(g, ["CategoryName"]), "revenue_by_region": _kpi(g, ["TerritoryRegion"]),
            "category_month_heatmap": heat}


def _segment_rows(g: DataFrame, keys: list[str]) -> DataFrame:
    """Lines pre-aggregated per (customer, keys) with the customer's segment."""
    pre = g.groupBy("CustomerID", *keys).agg(F.sum(REV).alias("_rev"), F.sum(PROF).alias("_prof"),
                                             F.count(F.lit(1)).alias("_lines"))
    seg = M.rfm_columns(g).select(F.col("CustomerID").alias("_cid"), "CustomerSegment")
    return pre.join(seg, pre.CustomerID.eqNullSafe(seg._cid), "left").drop("_cid")


def margin_by_segment(g: DataFrame) -> DataFrame:
    s = _segment_rows(g, ["CategoryName"])
    a = s.groupBy("CustomerSegment", "CategoryName").agg(F.sum("_rev").alias("TotalRevenue"),
                                                         F.sum("_prof").alias("TotalProfit"))
    return a.select("CustomerSegment", "CategoryName", "TotalRevenue", "TotalProfit",
                    round_half_up(divide("TotalProfit", "TotalRevenue", 0.0), 6).alias("ProfitMarginPct"))


def page_2(g: DataFrame, where=None) -> dict[str, DataFrame]:
    """Revenue & profitability."""
    g = _select(g, where)
    disc = (g.groupBy(M.dax_discount_bucket().alias("DiscountBucket"))
             .agg(F.count(F.lit(1)).alias("Lines"), F.sum(REV).alias("TotalRevenue"), F.sum(PROF).alias("TotalProfit")))
    return {"growth": M.time_intelligence(g).select("Year", "Month", "MoMGrowthPct", "YoYGrowthPct"),
            "margin_heatmap": margin_by_segment(g), "discount_table": disc,
            "ma6": M.moving_averages(g).select("Year", "Month", "MA6Month"),
            "margin_by_subcategory": M.core_measures(g, ["SubcategoryName"])
                                      .select("SubcategoryName", "TotalRevenue", "ProfitMarginPct")}


def segment_summary(g: DataFrame) -> DataFrame:
    r = M.rfm_columns(g)
    return r.groupBy("CustomerSegment").agg(F.count(F.lit(1)).alias("Customers"),
                                            F.sum("CustomerLTV").alias("TotalLTV"))


def page_3(g: DataFrame, where=None) -> dict[str, DataFrame]:
    """Customer behaviour and segmentation."""
    g = _select(g, where)
    r = M.rfm_columns(g)
    top = (g.groupBy("CustomerName").agg(F.sum(REV).alias("TotalRevenue"),
                                         distinctcount_blank("SalesOrderID").alias("Orders"))
            .orderBy(F.col("TotalRevenue").desc_nulls_last(), F.col("CustomerName").asc_nulls_first())
            .limit(TOP_N))
    repeat = g.groupBy("CustomerID").agg(distinctcount_blank("SalesOrderID").alias("_o")).agg(
        M.divide(F.sum((F.col("_o") > 1).cast("int")), F.count(F.lit(1)), 0.0).alias("RepeatCustomerPct"))
    return {"rfm_matrix": r.groupBy("RScore", "FScore").agg(F.count(F.lit(1)).alias("Customers")),
            "ltv_scatter": r.select("CustomerID", "CustomerLTV", "CustomerSegment"),
            "top_customers": top, "retention": M.customer_measures(g).select("Year", "Month", "RetentionRate"),
            "segments": segment_summary(g), "repeat_customers": repeat}


def pareto_curve(g: DataFrame) -> DataFrame:
    """Products by revenue with the cumulative share (running sum over the
    global product order, computed range-partitioned)."""
    p = g.groupBy("ProductName").agg(F.sum(REV).alias("TotalRevenue"))
    order = [F.col("TotalRevenue").desc_nulls_last(), F.col("ProductName").asc_nulls_first()]
    c = global_running_sum(p, order, "TotalRevenue", "_cum")
    return c.select("ProductName", "TotalRevenue",
                    round_half_up(divide("_cum", "_cum_total", 0.0) * 100, 6).alias("CumulativeSharePct"))


def page_4(g: DataFrame, where=None) -> dict[str, DataFrame]:
    """Product performance."""
    g = _select(g, where)
    growth = M.product_growth(g).select(F.col("ProductName").alias("_p"),
                                        round_half_up("_growth", 6).alias("YoYGrowthPct"))
    contrib = M.product_measures(g, [])
    portfolio = contrib.join(growth, contrib.ProductName.eqNullSafe(growth._p), "left").drop("_p")
    stages = M.lifecycle_stage(g).groupBy("ProductLifecycleStage").agg(
        distinctcount_blank("ProductName").alias("Products"))
    top = (g.groupBy("ProductName", "CategoryName").agg(F.sum(REV).alias("TotalRevenue"),
                                                         F.sum(PROF).alias("TotalProfit"))
            .orderBy(F.col("TotalRevenue").desc_nulls_last(), "ProductName", "CategoryName").limit(TOP_N))
    return {"portfolio": portfolio, "lifecycle_counts": stages, "pareto": pareto_curve(g),
            "margin_by_color_category": M.core_measures(g, ["ProductColor", "CategoryName"])
                                         .select("ProductColor", "CategoryName", "ProfitMarginPct"),
            "top_products": top}


def calendar_years(g: DataFrame) -> list[int]:
    """The calendar's years, for pivots (one row of bounds, known for a
    materialised record)."""
    b = calendar_bounds(g).first()
    return list(range(b.start.year, b.end.year + 1)) if b.start else []


def region_trend(g: DataFrame) -> DataFrame:
    return (M._dated(g).groupBy("TerritoryRegion", "Year")
                       .agg(F.sum(REV).alias("TotalRevenue"), F.sum(PROF).alias("TotalProfit"),
                            distinctcount_blank("SalesOrderID").alias("TotalOrders")))


def page_5(g: DataFrame, where=None) -> dict[str, DataFrame]:
    """Territory and regional performance."""
    g = _select(g, where)
    matrix = M._dated(g).groupBy("TerritoryName").pivot("Year", calendar_years(g)).agg(F.sum(REV))
    return {"ranking": M.territory_growth_rank(g), "region_kpis": _kpi(g, ["TerritoryRegion"]),
            "trend": region_trend(g), "territory_year_matrix": matrix}


def day_of_week(g: DataFrame) -> DataFrame:
    d = M._dated(g)
    a = d.groupBy(F.dayofweek("OrderDate").alias("DayOfWeek"),
                  F.date_format("OrderDate", "EEEE").alias("DayName")).agg(F.sum(REV).alias("TotalRevenue"))
    total = scalar(d.agg(F.sum(REV).alias("t")), "t")
    return a.select("*", round_half_up(divide("TotalRevenue", total, 0.0), 6).alias("RevenueShare"))


def page_6(g: DataFrame, where=None) -> dict[str, DataFrame]:
    """Time series and seasonality."""
    g = _select(g, where)
    d = M._dated(g)
    wp = M.weekpart_revenue(g).agg(F.sum("WeekdayRevenue").alias("WeekdayRevenue"),
                                   F.sum("WeekendRevenue").alias("WeekendRevenue"))
    return {"year_month": d.groupBy("Year", "Month").agg(F.sum(REV).alias("TotalRevenue")),
            "month_year_heatmap": d.groupBy("Month").pivot("Year", calendar_years(g)).agg(F.sum(REV)),
            "seasonal_index": M.seasonal_index(g), "day_of_week": day_of_week(g), "weekpart": wp,
            "month_year_series": d.groupBy(F.date_format("OrderDate", "MMM yyyy").alias("MonthYear"),
                                           "Year", "Month").agg(F.sum(REV).alias("TotalRevenue"))}


def channel_size(g: DataFrame) -> DataFrame:
    return (g.groupBy(M.order_online().alias("OrderOnline"), M.order_size_bucket().alias("OrderSizeBucket"))
             .agg(distinctcount_blank("SalesOrderID").alias("Orders"), F.count(F.lit(1)).alias("Lines"),
                  F.sum(REV).alias("TotalRevenue"), F.avg("DaysToShip").alias("_proc"))
             .withColumn("AvgProcessingDays", round_half_up("_proc", 6)).drop("_proc"))


def page_7(g: DataFrame, where=None) -> dict[str, DataFrame]:
    """Operational efficiency."""
    g = _select(g, where)
    return {"daily_orders": M._dated(g).groupBy("OrderDate").agg(distinctcount_blank("SalesOrderID").alias("Orders")),
            "channel_size": channel_size(g),
            "fulfilment_by_territory": M.operations_measures(g, ["TerritoryName"]),
            "kpis": M.operations_measures(g, [])}


def z_bands(g: DataFrame) -> DataFrame:
    sel = g.agg(F.avg(REV).alias("mu"), F.stddev_pop(REV).alias("sd"))
    z = divide(M._blank0(F.col(REV)).cast("double") - scalar(sel, "mu"), scalar(sel, "sd"), 0.0)
    band = F.when(F.abs(z) > Z_BANDS[0][0], F.lit(Z_BANDS[0][1])) \
            .when(F.abs(z) > Z_BANDS[1][0], F.lit(Z_BANDS[1][1])).otherwise(F.lit(Z_BAND_ELSE))
    return g.groupBy(band.alias("ZBand")).agg(F.count(F.lit(1)).alias("Lines"), F.sum(REV).alias("TotalRevenue"))


def page_8(g: DataFrame, where=None) -> dict[str, DataFrame]:
    """Anomaly detection and outliers."""
    g = _select(g, where)
    sel = g.agg(F.avg(REV).alias("mu"), F.stddev_pop(REV).alias("sd"), F.var_pop(REV).alias("var"))
    z = divide(M._blank0(F.col(REV)).cast("double") - scalar(sel, "mu"), scalar(sel, "sd"), 0.0)
    scored = g.select("SalesOrderID", "CategoryName", "OrderDate", REV, z.alias("_z"))
    scat = scored.select("SalesOrderID", "CategoryName", "OrderDate", REV, round_half_up("_z", 6).alias("RevenueZScore"))
    log = scored.where(F.abs("_z") > 2).select("SalesOrderID", "CategoryName", "OrderDate", REV,
                                               round_half_up("_z", 6).alias("RevenueZScore"))
    kpis = g.agg(round_half_up(F.avg(REV), 6).alias("MeanRevenue"), round_half_up(F.stddev_pop(REV), 6).alias("RevenueStdDev"),
                 round_half_up(F.var_pop(REV), 4).alias("RevenueVariance"),
                 round_half_up(divide(F.sum((F.abs(z) > 2).cast("int")), F.count(F.lit(1)), 0.0), 6).alias("OutlierPct"))
    return {"z_scatter": scat, "z_bands": z_bands(g), "outliers_by_category": M.anomaly_measures(g, ["CategoryName"]),
            "anomaly_log": log, "kpis": kpis}


def forecast_6m(g: DataFrame, scenario: Decimal = Decimal("0")) -> DataFrame:
    """Six-month forward forecast (re-aimed: the reference names the visual
    but gives no formula).  ``Forecast Next Month`` (MA6 × (1 + MoM +
    scenario)) is applied at the last data month, the forecast is taken as
    that month's revenue, and the step repeats six times.  The history is
    six monthly values from the dense month spine (one row)."""
    mon = M._monthly(g, [F.sum(REV).alias("TotalRevenue")])
    last = latest_order_date(g)
    pl = F.year(last) * 12 + F.month(last) - 1
    hist = mon.agg(*[F.sum(F.when(F.col("p") == pl - i, F.col("TotalRevenue"))).alias(f"v{5 - i}")
                     for i in range(6)])
    vals = [F.coalesce(F.col(f"v{i}").cast("double"), F.lit(0.0)) for i in range(6)]
    cols = [v.alias(f"h{i}") for i, v in enumerate(vals)]
    step = hist.select(*cols, pl.alias("_pl"))
    names = [f"h{i}" for i in range(6)]
    s = float(scenario)
    for k in range(1, FORECAST_MONTHS + 1):
        window = names[-6:]
        ma6 = sum((F.col(c) for c in window[1:]), F.col(window[0])) / 6
        mom = divide(F.col(window[-1]) - F.col(window[-2]), F.col(window[-2]), 0.0)
        step = step.select("*", (ma6 * (1 + mom + s)).alias(f"f{k}"))
        names.append(f"f{k}")
    rows = [F.struct(((F.col("_pl") + k) / 12).cast("int").alias("Year"),
                     ((F.col("_pl") + k) % 12 + 1).cast("int").alias("Month"),
                     F.lit(k).alias("Step"),
                     round_half_up(F.col(f"f{k}"), 4).alias("ForecastRevenue"))
            for k in range(1, FORECAST_MONTHS + 1)]
    return step.select(F.inline(F.array(*rows)))


def category_trend(g: DataFrame) -> DataFrame:
    """Trend Direction per category at the last data month."""
    last = latest_order_date(g)
    pl = F.year(last) * 12 + F.month(last) - 1
    p = F.col("OrderYear") * 12 + F.col("OrderMonth") - 1
    a = g.where(F.col("OrderDate").isNotNull()).groupBy("CategoryName").agg(
        F.sum(F.when(p == pl, F.col(REV))).alias("TotalRevenue"),
        (F.sum(F.when((p > pl - 6) & (p <= pl), F.col(REV))) / 6).alias("_ma6"))
    return a.select("CategoryName", "TotalRevenue", round_half_up("_ma6", 6).alias("MA6Month"),
                    M._trend(F.col("TotalRevenue"), F.col("_ma6")).alias("TrendDirection"))


def page_9(g: DataFrame, where=None) -> dict[str, DataFrame]:
    """Forecast and scenario planning."""
    g = _select(g, where)
    vol = g.agg(round_half_up(F.try_divide(F.stddev_pop(PROF), F.avg(PROF).cast("double")), 6).alias("ProfitVolatility"))
    return {"forecast_6m": forecast_6m(g), "scenarios": M.scenario_card(g), "volatility": vol,
            "trend_by_category": category_trend(g),
            "mom_vs_profit": M.time_intelligence(g).select("Year", "Month", "MoMGrowthPct", "MoMProfitGrowthPct"),
            "projection": M.scenario_card(g).where(F.col("ScenarioValue") == 0)}


PAGES = {1: page_1, 2: page_2, 3: page_3, 4: page_4, 5: page_5, 6: page_6, 7: page_7, 8: page_8, 9: page_9}


def write_pages(g: DataFrame, out_dir: str, where=None, pages=None) -> dict[str, str]:
    """Refresh: write every page dataset as Parquet to ``out_dir/page_<n>/<name>``
    (overwrite).  Datasets are small aggregates except the z-score scatter
    and anomaly log, which are row-level and written in parallel like any
    other table.  Returns {"page_<n>/<name>": path}."""
    written = {}
    for n, fn in PAGES.items():
        if pages is not None and n not in pages:
            continue
        for name, df in fn(g, where).items():
            path = f"{out_dir.rstrip('/')}/page_{n}/{name}"
            df.write.mode("overwrite").parquet(path)
            written[f"page_{n}/{name}"] = path
    return written
