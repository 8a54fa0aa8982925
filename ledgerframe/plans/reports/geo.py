"""Section 4 reports: geographic performance (D4.1), channel comparison (D4.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import count_distinct, nullif0, round_half_up, safe_div
from ...operators.levels import distinct_by_levels
from ..golden import latest_year


# Channel labels of the geo / channel reports.
ONLINE, OFFLINE = "Online", "Offline"


def channel_label(online) -> "F.Column":
    c = F.col(online) if isinstance(online, str) else online
    return F.when(c == F.lit(True), F.lit(ONLINE)).otherwise(F.lit(OFFLINE))


def geo_performance(g: DataFrame, years: int = 3, approx: bool = False) -> DataFrame:
    """D4.1 — territory × customer type × channel × year × currency.

    LAG and the year share are computed before the recent-years filter (CTE
    order).  The LAG partition omits currency (as in the reference); rows of
    one year are ordered by currency, region and country to make it
    deterministic.  A year's rows are combinations of dimensions, so the year
    share is a window over them and the fact is read once.
    """
    keys = ["TerritoryName", "TerritoryRegion", "CountryRegionCode", "CustomerType",
            "IsOnlineOrder", "OrderYear", "CurrencyCode"]
    placed = g.where(F.col("TerritoryName").isNotNull())
    if approx:
        gm = placed.groupBy(*keys).agg(
            F.sum("GrossRevenue").alias("TotalRevenue"), F.sum("EstimatedNetProfit").alias("TotalProfit"),
            F.count("GrossRevenue").alias("_n"), count_distinct("SalesOrderID", True).alias("OrderCount"),
            count_distinct("CustomerName", True).alias("UniqueCustomers"), count_distinct("ProductName", True).alias("UniqueProducts"))
    else:
        gm = distinct_by_levels(
            placed, keys, {"OrderCount": "SalesOrderID", "UniqueCustomers": "CustomerName"},
            {"TotalRevenue": ("sum", F.col("GrossRevenue")), "TotalProfit": ("sum", F.col("EstimatedNetProfit")),
             "_n": ("sum", F.col("GrossRevenue").isNotNull().cast("bigint"))}, ("UniqueProducts", "ProductName"))
    gm = gm.withColumn("AvgOrderValue", safe_div("TotalRevenue", "_n"))
    w = (Window.partitionBy("TerritoryName", "CustomerType", "IsOnlineOrder")
               .orderBy("OrderYear", F.col("CurrencyCode").asc_nulls_first(),
                        F.col("TerritoryRegion").asc_nulls_first(), F.col("CountryRegionCode").asc_nulls_first()))
    gw = gm.select("*", F.lag("TotalRevenue").over(w).alias("PriorYearRevenue"))
    gw = gw.select("*", F.sum("TotalRevenue").over(Window.partitionBy("OrderYear")).alias("_year_total"))
    out = (gw.where(F.col("OrderYear") >= latest_year(g) - (years - 1))
             .select("TerritoryName", "TerritoryRegion", "CountryRegionCode", "CustomerType",
                     channel_label("IsOnlineOrder").alias("Channel"), "OrderYear",
                     "TotalRevenue", "TotalProfit",
                     round_half_up(safe_div("TotalProfit", "TotalRevenue") * 100, 2).alias("ProfitMargin_Pct"),
                     round_half_up(safe_div(F.col("TotalRevenue") - F.col("PriorYearRevenue"), "PriorYearRevenue") * 100, 2)
                     .alias("YoY_Growth_Pct"),
                     round_half_up(safe_div("TotalRevenue", "_year_total") * 100, 2).alias("MarketShare_Pct"),
                     "OrderCount", "UniqueCustomers",
                     round_half_up(safe_div("OrderCount", "UniqueCustomers"), 2).alias("OrdersPerCustomer"),
                     round_half_up("AvgOrderValue", 6).alias("AvgOrderValue"),
                     round_half_up(safe_div("UniqueProducts", "OrderCount"), 2).alias("ProductDiversityIndex"))
             .orderBy(F.col("OrderYear").desc_nulls_last(), F.col("TotalRevenue").desc_nulls_last()))
    return out


def channel_comparison(g: DataFrame, years: int = 2, approx: bool = False) -> DataFrame:
    """D4.2 — online vs offline by category, customer type and month.

    Here the share window runs *after* the recent-years filter (same SELECT
    level in the reference); month and currency are grouped but not shown.
    """
    keys = ["IsOnlineOrder", "CategoryName", "CustomerType", "OrderYear", "OrderMonth", "CurrencyCode"]
    qty, disc = F.col("OrderQty").cast("bigint"), F.col("UnitPriceDiscount")
    states = {"Revenue": ("sum", F.col("GrossRevenue")), "Profit": ("sum", F.col("EstimatedNetProfit")),
              "_qty": ("sum", qty), "_qty_n": ("sum", qty.isNotNull().cast("bigint")),
              "_disc": ("sum", disc), "_disc_n": ("sum", disc.isNotNull().cast("bigint"))}
    # the filter is on a grouping column: rows of other years need no counting
    lines = g.where(F.col("OrderYear") >= latest_year(g) - (years - 1))
    if approx:
        recent = lines.groupBy(*keys).agg(
            *[F.sum(v).alias(n) for n, (_, v) in states.items()], count_distinct("SalesOrderID", True).alias("Orders"),
            count_distinct("CustomerName", True).alias("Customers"))
    else:
        recent = distinct_by_levels(lines, keys, {"Orders": "SalesOrderID", "Customers": "CustomerName"}, states)
    recent = recent.select(
        "*", channel_label("IsOnlineOrder").alias("Channel"),
        (F.col("_disc").cast("decimal(28,6)") / nullif0(F.col("_disc_n").cast("decimal(20,0)"))).alias("AvgDiscount"),
        F.when(F.col("_qty_n") > 0, F.call_function("div", F.col("_qty"), F.col("_qty_n")).cast("int")).alias("AvgQtyPerOrder"))
    # a channel's year holds combinations of dimensions and months
    recent = recent.select("*", F.sum("Revenue").over(Window.partitionBy("Channel", "OrderYear")).alias("_chan_total"))
    return (recent.select(
                "Channel", "CategoryName", "CustomerType", "OrderYear", "Revenue", "Profit",
                round_half_up(safe_div("Profit", "Revenue") * 100, 2).alias("Margin_Pct"),
                "Orders", "Customers",
                round_half_up(safe_div("Revenue", "Orders"), 2).alias("AvgOrderValue"),
                round_half_up(safe_div("Revenue", "Customers"), 2).alias("RevenuePerCustomer"),
                round_half_up(safe_div("Orders", "Customers"), 2).alias("OrdersPerCustomer"),
                "AvgQtyPerOrder",
                round_half_up(F.col("AvgDiscount") * 100, 2).alias("AvgDiscount_Pct"),
                round_half_up(safe_div("Profit", "Orders"), 2).alias("ProfitPerOrder"),
                round_half_up(safe_div("Revenue", "_chan_total") * 100, 2).alias("ChannelShare_Pct"))
            .orderBy(F.col("OrderYear").desc_nulls_last(), F.col("Channel").asc_nulls_first(),
                     F.col("Revenue").desc_nulls_last()))
