"""Section 6 reports: order status and fulfilment (D6.1), anomaly detection
(D6.2)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import count_distinct, day_diff, int_avg, lit_date, round_half_up, safe_div
from ...operators.stats import scalar

# Statuses that carry no revenue at risk and the display order
# of D6.1 (most of these names never occur in the cleaned status codes).
SETTLED_STATUSES = ["Completed", "Shipped", "Delivered"]
STATUS_DISPLAY_ORDER = ["Pending", "Processing", "Shipped", "Delivered", "Completed", "Cancelled"]
Z_EXTREME, Z_SIGNIFICANT, Z_MODERATE = 3, 2, 1.5


def status_fulfilment(g: DataFrame, as_of: _dt.date | None = None, approx: bool = False) -> DataFrame:
    """D6.1 — status × customer type × channel × region × currency.

    ``SUM(COUNT(*)) OVER ()`` is a scalar subquery over the grouped rows
    (one value), not a single-partition window.
    """
    grp = (g.where(F.col("OrderStatus").isNotNull())
            .groupBy("OrderStatus", "CustomerType", "IsOnlineOrder", "TerritoryRegion", "CurrencyCode")
            .agg(count_distinct("SalesOrderID", approx).alias("OrderCount"),
                 F.count(F.lit(1)).alias("LineItemCount"),
                 F.sum("GrossRevenue").alias("TotalRevenue"),
                 F.avg("GrossRevenue").alias("_aov"),
                 F.sum("EstimatedNetProfit").alias("TotalProfit"),
                 int_avg(day_diff(F.col("OrderDate"), lit_date(as_of))).alias("AvgDaysSinceOrder")))
    total = scalar(grp.agg(F.sum("LineItemCount").alias("t")), "t")
    order = None
    for i, s in enumerate(STATUS_DISPLAY_ORDER, 1):
        order = (F.when(F.col("OrderStatus") == s, F.lit(i)) if order is None
                 else order.when(F.col("OrderStatus") == s, F.lit(i)))
    return (grp.select(
                "OrderStatus", "CustomerType", "IsOnlineOrder", "TerritoryRegion", "CurrencyCode",
                "OrderCount", "LineItemCount", "TotalRevenue",
                round_half_up("_aov", 6).alias("AvgOrderValue"),
                "TotalProfit",
                round_half_up(F.col("LineItemCount") * 100.0 / total, 2).alias("Status_Distribution_Pct"),
                F.when(~F.col("OrderStatus").isin(*SETTLED_STATUSES), F.col("TotalRevenue"))
                 .otherwise(F.lit(0).cast("decimal(38,6)")).alias("RevenueAtRisk"),
                "AvgDaysSinceOrder",
                order.otherwise(F.lit(len(STATUS_DISPLAY_ORDER) + 1)).alias("_o"))
            .orderBy("_o", F.col("TotalRevenue").desc_nulls_last()).drop("_o"))


def anomaly_detection(g: DataFrame, approx: bool = False) -> DataFrame:
    """D6.2 — daily × category × currency z-scores against the category's
    daily mean and sample deviation.

    The category window holds aggregated *days* (bounded by the calendar ×
    currencies).  AVG(DailyOrders) averages an integer count, so it is an
    integer mean (T-SQL), unlike AVG(DailyRevenue).
    """
    daily = (g.where(F.col("OrderDate").isNotNull())
              .groupBy("OrderDate", "CategoryName", "CurrencyCode")
              .agg(count_distinct("SalesOrderID", approx).cast("int").alias("DailyOrders"),
                   F.sum("GrossRevenue").alias("DailyRevenue"),
                   F.avg("GrossRevenue").alias("AvgOrderValue"),
                   F.sum(F.col("OrderQty").cast("bigint")).alias("DailyQty")))
    w = Window.partitionBy("CategoryName")
    st = daily.select(
        "*",
        F.avg("DailyRevenue").over(w).alias("AvgRevenue"),
        F.stddev_samp("DailyRevenue").over(w).alias("StdDevRevenue"),
        F.call_function("div", F.sum(F.col("DailyOrders").cast("bigint")).over(w),
                        F.count("DailyOrders").over(w)).alias("AvgOrders"),
        F.stddev_samp("DailyOrders").over(w).alias("StdDevOrders"))
    z = st.select("*",
                  safe_div(F.col("DailyRevenue").cast("double") - F.col("AvgRevenue").cast("double"),
                           "StdDevRevenue").alias("Revenue_ZScore"),
                  safe_div(F.col("DailyOrders") - F.col("AvgOrders"), "StdDevOrders").alias("Orders_ZScore"))
    rz, oz = F.abs(F.col("Revenue_ZScore")), F.abs(F.col("Orders_ZScore"))
    level = (F.when((rz > Z_EXTREME) | (oz > Z_EXTREME), F.lit("Extreme Anomaly"))
              .when((rz > Z_SIGNIFICANT) | (oz > Z_SIGNIFICANT), F.lit("Significant Anomaly"))
              .when((rz > Z_MODERATE) | (oz > Z_MODERATE), F.lit("Moderate Anomaly"))
              .otherwise(F.lit("Normal")))
    return (z.where((rz > Z_MODERATE) | (oz > Z_MODERATE))
             .orderBy(rz.desc_nulls_last())
             .select("OrderDate", "CategoryName", "DailyOrders", "DailyRevenue",
                     round_half_up("AvgOrderValue", 6).alias("AvgOrderValue"),
                     round_half_up("Revenue_ZScore", 2).alias("Revenue_ZScore"),
                     round_half_up("Orders_ZScore", 2).alias("Orders_ZScore"),
                     level.alias("AnomalyLevel"),
                     F.when(F.col("Revenue_ZScore") > 0, F.lit("Above Average"))
                      .otherwise(F.lit("Below Average")).alias("Direction")))
