"""Section 3 reports: BCG portfolio matrix (D3.1), product affinity (D3.2),
product lifecycle by month (D3.3)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import count_distinct, dec_avg, month_boundaries, round_half_up, safe_div
from ...operators.pairs import basket_items, item_pairs
from ...operators.stats import join_group_stats, known, scalar
from ..golden import latest_year

# BCG labels, recommendation texts and display rank.
BCG_GROWTH_THRESHOLD = 0.15
BCG_RECOMMENDATION = {
    "Stars": "Invest for growth - High priority",
    "Cash Cows": "Maintain & maximize profit",
    "Question Marks": "Evaluate: Invest or divest",
    "Dogs": "Consider discontinuation or reposition",
}
BCG_RECOMMENDATION_ELSE = "Needs analysis"
BCG_RANK = {"Stars": 1, "Question Marks": 2, "Cash Cows": 3, "Dogs": 4}
AFFINITY_MIN_PAIRS = 3
LIFECYCLE_INTRO_MONTHS = 3
LIFECYCLE_GROWTH_MONTHS = 12


def bcg_matrix(g: DataFrame, approx: bool = False) -> DataFrame:
    """D3.1 — product portfolio (BCG) per product × currency.

    ``@maxYear`` is one scalar subquery.  Category totals / means use a
    partial aggregation joined back on the category (not a window holding a
    whole category in one task).  A zero category total returns NULL where
    the reference would raise.
    """
    my = latest_year(g)
    rev = F.col("GrossRevenue")
    pm = (g.where(F.col("ProductName").isNotNull())
           .groupBy("ProductName", "CategoryName", "SubcategoryName", "CurrencyCode")
           .agg(F.sum("GrossRevenue").alias("TotalRevenue"),
                F.sum(F.col("OrderQty").cast("bigint")).alias("TotalQtySold"),
                count_distinct("SalesOrderID", approx).alias("OrderCount"),
                count_distinct("CustomerName", approx).alias("UniqueCustomers"),
                F.sum(F.when(F.col("OrderYear") == my, rev).otherwise(F.lit(0))).alias("CurrentYearRevenue"),
                F.sum(F.when(F.col("OrderYear") == my - 1, rev).otherwise(F.lit(0))).alias("PriorYearRevenue"),
                F.sum("EstimatedNetProfit").alias("TotalProfit"),
                F.avg(safe_div("EstimatedNetProfit", "GrossRevenue")).alias("AvgMargin")))
    ms = join_group_stats(pm, ["CategoryName"], [
        F.sum("TotalRevenue").alias("_cat_sum"), F.avg("TotalRevenue").alias("_cat_avg")])
    share = safe_div("TotalRevenue", "_cat_sum")
    growth = safe_div(F.col("CurrentYearRevenue") - F.col("PriorYearRevenue"), "PriorYearRevenue")
    rel = safe_div("TotalRevenue", "_cat_avg")
    bcg = (F.when((rel > 1) & (growth > BCG_GROWTH_THRESHOLD), F.lit("Stars"))
            .when((rel > 1) & (growth <= BCG_GROWTH_THRESHOLD), F.lit("Cash Cows"))
            .when((rel <= 1) & (growth > BCG_GROWTH_THRESHOLD), F.lit("Question Marks"))
            .when((rel <= 1) & (growth <= BCG_GROWTH_THRESHOLD), F.lit("Dogs"))
            .otherwise(F.lit("Unclassified")))
    c = ms.select("*", bcg.alias("BCG_Category"), share.alias("_share"), growth.alias("_growth"),
                  rel.alias("_rel"))
    recommend = None
    rank = None
    for k, v in BCG_RECOMMENDATION.items():
        recommend = (F.when(F.col("BCG_Category") == k, F.lit(v)) if recommend is None
                     else recommend.when(F.col("BCG_Category") == k, F.lit(v)))
    for k, v in BCG_RANK.items():
        rank = (F.when(F.col("BCG_Category") == k, F.lit(v)) if rank is None
                else rank.when(F.col("BCG_Category") == k, F.lit(v)))
    out = c.select(
        "ProductName", "CategoryName", "SubcategoryName", "BCG_Category",
        round_half_up("TotalRevenue", 2).alias("TotalRevenue"),
        round_half_up(F.col("_share") * 100, 2).alias("CategoryShare_Pct"),
        round_half_up("_rel", 2).alias("RelativeMarketShare"),
        round_half_up(F.col("_growth") * 100, 2).alias("YoY_Growth_Pct"),
        round_half_up(F.col("AvgMargin") * 100, 2).alias("AvgMargin_Pct"),
        "OrderCount", "UniqueCustomers",
        recommend.otherwise(F.lit(BCG_RECOMMENDATION_ELSE)).alias("StrategyRecommendation"),
        rank.otherwise(F.lit(5)).alias("_rank"),
    )
    return out.orderBy("_rank", F.col("TotalRevenue").desc_nulls_last()).drop("_rank")


def product_affinity(g: DataFrame, top: int | None = 20, collation: str | None = None) -> DataFrame:
    """D3.2 — products bought together in the same order.

    Pairs are built from distinct items per order (``operators.pairs``) and
    the line-pair statistics are reconstructed exactly.  AffinityScore is the
    support in percent of all orders (the reference calls it lift).
    """
    orders = scalar(g.agg(F.countDistinct("SalesOrderID").alias("n")), "n")
    named = g.where(F.col("ProductName").isNotNull())
    items = basket_items(named, "SalesOrderID", ["ProductName", "CategoryName", "CurrencyCode"], "GrossRevenue")
    pairs = item_pairs(items, "SalesOrderID", ["ProductName", "CategoryName", "CurrencyCode"], "ProductName",
                       collation=collation, together=bool(known(g, "by_order")))
    agg = (pairs.groupBy(F.col("ProductName1").alias("Product1"), F.col("CategoryName1").alias("Category1"),
                         F.col("ProductName2").alias("Product2"), F.col("CategoryName2").alias("Category2"),
                         "CurrencyCode1", "CurrencyCode2")
                .agg(F.sum("pair_lines").alias("TimesBoughtTogether"),
                     F.sum("pair_value_sum").alias("TotalBundleRevenue"),
                     F.sum("pair_value_n").alias("_n"))
                .where(F.col("TimesBoughtTogether") >= AFFINITY_MIN_PAIRS))
    denom = (orders.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("double")
    keys = ["Product1", "Category1", "Product2", "Category2", "CurrencyCode1", "CurrencyCode2"]
    out = agg.select(
        *keys[:4], "CurrencyCode1", "CurrencyCode2", "TimesBoughtTogether",
        round_half_up(safe_div("TotalBundleRevenue", "_n"), 6).alias("AvgBundleRevenue"),
        "TotalBundleRevenue",
        (F.col("TimesBoughtTogether").cast("double") / denom).alias("AffinityScore"),
    ).orderBy(F.col("TimesBoughtTogether").desc_nulls_last(), F.col("TotalBundleRevenue").desc_nulls_last(),
              *[F.col(k).asc_nulls_first() for k in keys])
    return out.limit(top) if top else out


def product_lifecycle(g: DataFrame) -> DataFrame:
    """D3.3 — monthly lifecycle stage per product in the latest year.

    The 3-month moving average is computed over all months *before* the
    latest-year filter (as the CTE order implies).  Its window partition is
    (product, currency) over aggregated months, bounded by the calendar;
    months with several categories are ordered by category.
    """
    dates = (g.where(F.col("ProductName").isNotNull()).groupBy("ProductName")
              .agg(F.min("OrderDate").alias("ProductLaunchDate"),
                   F.max("OrderDate").alias("ProductLastSaleDate")))
    tl = (g.groupBy("ProductName", "CategoryName", "OrderYear", "OrderMonth", "CurrencyCode")
           .agg(F.sum("GrossRevenue").alias("MonthlyRevenue"),
                F.sum(F.col("OrderQty").cast("bigint")).alias("MonthlyQty"),
                F.countDistinct("SalesOrderID").alias("MonthlyOrders"),
                dec_avg("UnitPrice").alias("AvgPrice")))
    w = (Window.partitionBy("ProductName", "CurrencyCode")
               .orderBy("OrderYear", "OrderMonth", F.col("CategoryName").asc_nulls_first())
               .rowsBetween(-2, 0))
    age = tl.join(dates, "ProductName").select(
        "*",
        month_boundaries(F.col("ProductLaunchDate"),
                         F.make_date(F.col("OrderYear"), F.col("OrderMonth"), F.lit(1))).alias("MonthsSinceLaunch"),
        month_boundaries(F.col("ProductLaunchDate"), F.col("ProductLastSaleDate")).alias("ProductLifetimeMonths"),
        F.avg("MonthlyRevenue").over(w).alias("MA3_Revenue"))
    rev, ma = F.col("MonthlyRevenue"), F.col("MA3_Revenue")
    msl = F.col("MonthsSinceLaunch")
    stage = (F.when(msl <= LIFECYCLE_INTRO_MONTHS, F.lit("Introduction"))
              .when((msl <= LIFECYCLE_GROWTH_MONTHS) & (rev > ma * F.lit(Decimal("1.1"))), F.lit("Growth"))
              .when((rev >= ma * F.lit(Decimal("0.9"))) & (rev <= ma * F.lit(Decimal("1.1"))), F.lit("Maturity"))
              .when(rev < ma * F.lit(Decimal("0.9")), F.lit("Decline"))
              .otherwise(F.lit("Stable")))
    out = (age.where(F.col("OrderYear") == latest_year(g))
              .orderBy(F.col("ProductName").asc_nulls_first(), F.col("OrderYear").desc_nulls_last(),
                       F.col("OrderMonth").desc_nulls_last())
              .select("ProductName", "CategoryName", "ProductLaunchDate", "ProductLifetimeMonths",
                      "MonthsSinceLaunch", "MonthlyRevenue",
                      round_half_up(ma, 6).alias("MA3_Revenue"),
                      stage.alias("LifecycleStage"),
                      round_half_up(safe_div(rev - ma, ma) * 100, 2).alias("Deviation_From_Trend_Pct")))
    return out
