"""Section 5 reports: price sensitivity (D5.1), promotion effectiveness (D5.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import dec_avg, int_avg, round_half_up, safe_div

# Price tier ladder (strict upper bounds) and labels.
PRICE_TIERS = [(100, "1_Budget (<$100)"), (500, "2_Mid ($100-500)"), (1000, "3_Premium ($500-1K)")]
PRICE_TIER_ELSE = "4_Luxury (>$1K)"
PROMO_NONE, PROMO_ON = "No Promotion", "On Promotion"
PROMO_MIN_TRANSACTIONS = 5


def price_tier(price) -> "F.Column":
    p = F.col(price) if isinstance(price, str) else price
    out = None
    for bound, label in PRICE_TIERS:
        out = F.when(p < bound, F.lit(label)) if out is None else out.when(p < bound, F.lit(label))
    return out.otherwise(F.lit(PRICE_TIER_ELSE))


def price_sensitivity(g: DataFrame) -> DataFrame:
    """D5.1 — price tier × category × customer type (× currency, not shown).

    AVG(OrderQty) is an integer average (T-SQL), also inside the elasticity
    proxy.  A zero price deviation returns NULL where the reference raises.
    """
    t = g.where(F.col("UnitPrice") > 0).select(
        "CategoryName", "CustomerType", "CurrencyCode", price_tier("UnitPrice").alias("PriceRange"),
        "UnitPrice", "UnitPriceDiscount", "OrderQty", "GrossRevenue", "EstimatedNetProfit")
    a = t.groupBy("PriceRange", "CategoryName", "CustomerType", "CurrencyCode").agg(
        F.count(F.lit(1)).alias("TransactionCount"),
        F.sum(F.col("OrderQty").cast("bigint")).alias("TotalQtySold"),
        int_avg("OrderQty").alias("AvgQtyPerTransaction"),
        F.sum("GrossRevenue").alias("TotalRevenue"),
        F.avg("GrossRevenue").alias("_avg_rev"),
        dec_avg("UnitPrice").alias("_avg_price"),
        F.min("UnitPrice").alias("MinPrice"),
        F.max("UnitPrice").alias("MaxPrice"),
        F.stddev_samp("UnitPrice").alias("_sd_price"),
        dec_avg(F.col("UnitPriceDiscount") * 100).alias("_avg_disc"),
        F.sum(F.when(F.col("UnitPriceDiscount") > 0, 1).otherwise(0)).alias("_disc_lines"),
        F.sum("EstimatedNetProfit").alias("TotalProfit"),
        F.avg(safe_div("EstimatedNetProfit", "GrossRevenue") * 100).alias("_avg_m"),
        F.stddev_samp("OrderQty").alias("_sd_qty"))
    elasticity = safe_div(safe_div("_sd_qty", "AvgQtyPerTransaction"),
                          safe_div("_sd_price", "_avg_price"))
    return (a.select(
                "PriceRange", "CategoryName", "CustomerType", "TransactionCount", "TotalQtySold",
                "AvgQtyPerTransaction", "TotalRevenue",
                round_half_up("_avg_rev", 6).alias("AvgTransactionValue"),
                round_half_up("_avg_price", 6).alias("AvgPrice"),
                "MinPrice", "MaxPrice",
                round_half_up("_sd_price", 6).alias("PriceStdDev"),
                round_half_up("_avg_disc", 6).alias("AvgDiscount_Pct"),
                round_half_up(F.col("_disc_lines") * 100.0 / F.col("TransactionCount"), 6)
                .alias("Discount_Penetration_Pct"),
                "TotalProfit",
                round_half_up("_avg_m", 6).alias("AvgMargin_Pct"),
                round_half_up(elasticity, 2).alias("Elasticity_Proxy"))
            .orderBy(F.col("PriceRange").asc_nulls_first(), F.col("TotalRevenue").desc_nulls_last()))


def promo_status(disc) -> "F.Column":
    d = F.col(disc) if isinstance(disc, str) else disc
    return F.when(d == 0, F.lit(PROMO_NONE)).otherwise(F.lit(PROMO_ON))


def promotion_effectiveness(g: DataFrame) -> DataFrame:
    """D5.2 — two-level aggregation: month level, then year level.

    IncrementalRevenuePerTransaction subtracts the mean of the
    'No Promotion' rows *of the same group*, so it is NULL for every
    'On Promotion' group (kept).
    """
    lvl1 = g.groupBy("OrderYear", "OrderMonth", "CategoryName", "ProductName", "CustomerType",
                     "CurrencyCode", promo_status("UnitPriceDiscount").alias("PromoStatus")).agg(
        F.count(F.lit(1)).alias("Transactions"),
        F.sum(F.col("OrderQty").cast("bigint")).alias("TotalQty"),
        F.sum("GrossRevenue").alias("Revenue"),
        F.sum("EstimatedNetProfit").alias("Profit"),
        dec_avg("UnitPrice").alias("AvgPrice"),
        dec_avg("UnitPriceDiscount").alias("AvgDiscount"))
    per_txn = safe_div("Revenue", "Transactions")
    lvl2 = lvl1.groupBy("OrderYear", "CategoryName", "ProductName", "PromoStatus").agg(
        F.sum("Transactions").alias("TotalTransactions"),
        F.sum("TotalQty").alias("TotalQuantity"),
        F.sum("Revenue").alias("TotalRevenue"),
        F.avg(per_txn).alias("_avg_txn"),
        F.sum("Profit").alias("TotalProfit"),
        F.avg(safe_div("Profit", "Revenue") * 100).alias("_avg_m"),
        F.avg(F.col("AvgDiscount").cast("double") * 100).alias("_avg_d"),
        F.avg(F.when(F.col("PromoStatus") == PROMO_NONE, per_txn)).alias("_base"))
    return (lvl2.where(F.col("TotalTransactions") >= PROMO_MIN_TRANSACTIONS)
                .select("OrderYear", "CategoryName", "ProductName", "PromoStatus",
                        "TotalTransactions", "TotalQuantity", "TotalRevenue",
                        round_half_up("_avg_txn", 6).alias("AvgTransactionValue"),
                        "TotalProfit",
                        round_half_up("_avg_m", 6).alias("AvgMargin_Pct"),
                        round_half_up("_avg_d", 6).alias("AvgDiscount_Pct"),
                        round_half_up(safe_div("TotalRevenue", "TotalTransactions") - F.col("_base"), 6)
                        .alias("IncrementalRevenuePerTransaction"))
                .orderBy(F.col("OrderYear").desc_nulls_last(), F.col("TotalRevenue").desc_nulls_last()))
