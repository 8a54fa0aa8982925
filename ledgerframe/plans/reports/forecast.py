"""Section 7 report: trend analysis for forecasting (D7.1)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import round_half_up, safe_div
from ..golden import latest_year

# Trend ladder multipliers against the 6-month moving average.
TREND_LADDER = [("1.1", "Strong Growth"), ("1.05", "Moderate Growth"), ("0.95", "Stable"),
                ("0.90", "Moderate Decline")]
TREND_ELSE = "Strong Decline"


def trend_direction(value, ma) -> "F.Column":
    out = None
    for mult, label in TREND_LADDER:
        cond = value > ma * F.lit(Decimal(mult))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(TREND_ELSE))


def forecast_trend(g: DataFrame, years: int = 3) -> DataFrame:
    """D7.1 — monthly revenue per category with MA6 (over all months), then
    LAG 12 and a 12-row deviation over the *filtered* recent years only.

    The windows are per category over aggregated (month, currency) rows,
    bounded by the calendar; rows of one month are ordered by currency.
    """
    mt = (g.where(F.col("OrderDate").isNotNull())
           .groupBy("OrderYear", "OrderMonth", "CategoryName", "CurrencyCode")
           .agg(F.sum("GrossRevenue").alias("MonthlyRevenue"),
                F.countDistinct("SalesOrderID").alias("MonthlyOrders"),
                F.countDistinct("CustomerName").alias("MonthlyCustomers")))
    w = (Window.partitionBy("CategoryName")
               .orderBy("OrderYear", "OrderMonth", F.col("CurrencyCode").asc_nulls_first()))
    ts = mt.select("*",
                   F.row_number().over(w).alias("MonthIndex"),
                   F.avg("MonthlyRevenue").over(w.rowsBetween(-5, 0)).alias("MA6_Revenue"),
                   F.avg("MonthlyRevenue").over(Window.partitionBy("CategoryName")).alias("OverallAvgRevenue"))
    recent = ts.where(F.col("OrderYear") >= latest_year(g) - (years - 1))
    lag12 = F.lag("MonthlyRevenue", 12).over(w)
    rev, ma = F.col("MonthlyRevenue"), F.col("MA6_Revenue")
    return (recent.select(
                "OrderYear", "OrderMonth", "CategoryName", "MonthlyRevenue",
                round_half_up(ma, 6).alias("MA6_Revenue"),
                trend_direction(rev, ma).alias("TrendDirection"),
                lag12.alias("SameMonthLastYear"),
                round_half_up(safe_div(rev - lag12, lag12) * 100, 2).alias("YoY_Change_Pct"),
                round_half_up(F.stddev_samp("MonthlyRevenue").over(w.rowsBetween(-11, 0)), 6)
                .alias("Revenue_Volatility"))
            .orderBy(F.col("CategoryName").asc_nulls_first(), F.col("OrderYear").desc_nulls_last(),
                     F.col("OrderMonth").desc_nulls_last()))
