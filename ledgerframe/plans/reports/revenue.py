"""Section 1 reports: revenue trend (D1.1), margin by dimension (D1.2),
discount impact (D1.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import count_distinct, dec_avg, int_avg, round_half_up, safe_div

# Discount bucket ladder of the deep-dive report (upper bounds
# inclusive, first match wins; NULL falls to the last label).
SQL_DISCOUNT_BUCKETS = [(0.0, "No Discount", "eq"), (0.05, "Small (0-5%)", "le"),
                        (0.15, "Medium (5-15%)", "le"), (0.30, "Large (15-30%)", "le")]
SQL_DISCOUNT_ELSE = "VeryLarge (>30%)"


def revenue_trend(g: DataFrame, top: int | None = 10) -> DataFrame:
    """D1.1 — monthly revenue per currency with MoM / YoY growth and a 3-row
    moving average.

    LAG(1) / LAG(12) are physical row offsets (a missing month shifts them),
    as in the reference.  The window runs over the aggregated (year, month,
    currency) rows only — per currency that is at most the number of months
    in the data, so the partition is bounded by the calendar, not by volume.
    """
    monthly = (g.where(F.col("OrderDate").isNotNull())
                .groupBy("OrderYear", "OrderMonth", "CurrencyCode")
                .agg(F.sum("GrossRevenue").alias("MonthlyRevenue"),
                     F.sum("EstimatedNetProfit").alias("MonthlyProfit"),
                     F.countDistinct("SalesOrderID").alias("OrderCount"),
                     F.countDistinct("CustomerName").alias("UniqueCustomers")))
    w = Window.partitionBy("CurrencyCode").orderBy("OrderYear", "OrderMonth")
    rw = monthly.select(
        "*",
        F.lag("MonthlyRevenue", 1).over(w).alias("PrevMonthRevenue"),
        F.lag("MonthlyRevenue", 12).over(w).alias("YoYRevenue"),
        F.avg("MonthlyRevenue").over(w.rowsBetween(-2, 0)).alias("MA3"))
    rev = F.col("MonthlyRevenue")
    out = rw.select(
        "OrderYear", "OrderMonth", "CurrencyCode", "MonthlyRevenue", "MonthlyProfit",
        round_half_up(safe_div(rev - F.col("PrevMonthRevenue"), F.col("PrevMonthRevenue")) * 100, 2).alias("MoM_Growth_Pct"),
        round_half_up(safe_div(rev - F.col("YoYRevenue"), F.col("YoYRevenue")) * 100, 2).alias("YoY_Growth_Pct"),
        round_half_up(safe_div(F.col("MonthlyProfit"), rev) * 100, 2).alias("ProfitMargin_Pct"),
        round_half_up(F.col("MA3"), 6).alias("ThreeMonth_MA"),
        round_half_up(safe_div(rev - F.col("MA3"), F.col("MA3")) * 100, 2).alias("Deviation_From_Trend_Pct"),
    ).orderBy(F.col("CurrencyCode").asc_nulls_first(), F.col("OrderYear").desc_nulls_last(),
              F.col("OrderMonth").desc_nulls_last())
    return out.limit(top) if top else out


def margin_by_dimension(g: DataFrame, top: int | None = 10, approx: bool = False) -> DataFrame:
    """D1.2 — margin statistics by category / subcategory / colour / customer
    type / currency, groups with at least five distinct orders."""
    keys = ["CategoryName", "SubcategoryName", "ProductColor", "CustomerType", "CurrencyCode"]
    row_margin = safe_div("EstimatedNetProfit", "GrossRevenue") * 100
    agg = (g.where(F.col("EstimatedNetProfit").isNotNull() & (F.col("GrossRevenue") > 0))
            .groupBy(*keys)
            .agg(F.sum("GrossRevenue").alias("TotalRevenue"),
                 F.sum("EstimatedNetProfit").alias("TotalProfit"),
                 F.avg(row_margin).alias("_avg_m"), F.min(row_margin).alias("_min_m"),
                 F.max(row_margin).alias("_max_m"),
                 count_distinct("SalesOrderID", approx).alias("OrderCount"),
                 F.sum(F.col("OrderQty").cast("bigint")).alias("TotalQty"),
                 F.avg("GrossRevenue").alias("_aov"))
            .where(F.col("OrderCount") >= 5))
    out = agg.select(
        *keys, "TotalRevenue", "TotalProfit",
        round_half_up("_avg_m", 2).alias("AvgMargin_Pct"),
        round_half_up("_min_m", 2).alias("MinMargin_Pct"),
        round_half_up("_max_m", 2).alias("MaxMargin_Pct"),
        "OrderCount", "TotalQty",
        round_half_up("_aov", 2).alias("AvgOrderValue"),
    ).orderBy(F.col("TotalProfit").desc_nulls_last(), *[F.col(k).asc_nulls_first() for k in keys])
    return out.limit(top) if top else out


def sql_discount_bucket(disc) -> "F.Column":
    d = F.col(disc) if isinstance(disc, str) else disc
    out = None
    for bound, label, op in SQL_DISCOUNT_BUCKETS:
        cond = (d == bound) if op == "eq" else (d <= bound)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(SQL_DISCOUNT_ELSE))


def discount_impact(g: DataFrame, top: int | None = 10) -> DataFrame:
    """D1.3 — discount buckets × category × currency."""
    b = g.select(sql_discount_bucket("UnitPriceDiscount").alias("DiscountBucket"),
                 "UnitPriceDiscount", "OrderQty", "CurrencyCode", "GrossRevenue",
                 "EstimatedNetProfit", "CategoryName")
    agg = b.groupBy("DiscountBucket", "CategoryName", "CurrencyCode").agg(
        F.count(F.lit(1)).alias("TransactionCount"),
        int_avg("OrderQty").alias("AvgQtyPerOrder"),
        F.sum(F.col("OrderQty").cast("bigint")).alias("TotalQty"),
        F.sum("GrossRevenue").alias("TotalRevenue"),
        F.avg("GrossRevenue").alias("_avg_rev"),
        F.sum("EstimatedNetProfit").alias("TotalProfit"),
        F.avg(safe_div("EstimatedNetProfit", "GrossRevenue") * 100).alias("_avg_m"),
        dec_avg(F.col("UnitPriceDiscount") * 100).alias("_avg_d"),
        F.sum("UnitPriceDiscount").alias("_sum_d"))
    out = agg.select(
        "DiscountBucket", "CategoryName", "TransactionCount", "AvgQtyPerOrder", "TotalQty",
        "CurrencyCode", "TotalRevenue",
        round_half_up("_avg_rev", 2).alias("AvgRevenuePerOrder"),
        "TotalProfit",
        round_half_up("_avg_m", 2).alias("AvgMargin_Pct"),
        round_half_up("_avg_d", 2).alias("AvgDiscount_Pct"),
        round_half_up(safe_div("TotalRevenue", "_sum_d"), 2).alias("Revenue_Per_Discount_Dollar"),
    ).orderBy(F.col("DiscountBucket").asc_nulls_first(), F.col("TotalRevenue").desc_nulls_last(),
              F.col("CategoryName").asc_nulls_first(), F.col("CurrencyCode").asc_nulls_first())
    return out.limit(top) if top else out
