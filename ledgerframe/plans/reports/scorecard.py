"""Section 8 report: business health scorecard (D8.1).

The reference uses a dozen nested scalar subqueries for the latest month,
the prior month (January wraps to December) and the same month last year.
Here one scalar subquery finds the latest (year, month); each line is tagged
with the period it belongs to (at most one), one grouped aggregation over the
tagged lines yields the three periods, and five metric rows are emitted from
that single small row as an inline array of structs (no cross join, no
union of re-scans).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import count_distinct, round_half_up, safe_div
from ...operators.stats import scalar

# Health thresholds per metric (fraction change or level).
GROWTH_LADDER = [(0.05, "Excellent"), (0.0, "Good"), (-0.05, "Warning")]
CUSTOMER_LADDER = [(0.10, "Excellent"), (0.0, "Good"), (-0.05, "Warning")]
MARGIN_LADDER = [(0.25, "Excellent"), (0.15, "Good"), (0.05, "Warning")]
HEALTH_ELSE = "Critical"


def _ladder(x, ladder) -> "F.Column":
    out = None
    for t, label in ladder:
        out = F.when(x > t, F.lit(label)) if out is None else out.when(x > t, F.lit(label))
    return out.otherwise(F.lit(HEALTH_ELSE))


def health_scorecard(g: DataFrame, approx: bool = False) -> DataFrame:
    latest = scalar(g.agg(F.max(F.struct("OrderYear", "OrderMonth")).alias("l")), "l")
    y, m = latest.getField("OrderYear"), latest.getField("OrderMonth")
    yr, mo = F.col("OrderYear"), F.col("OrderMonth")
    period = (F.when((yr == y) & (mo == m), F.lit("c"))
               .when(((yr == y) & (mo == m - 1)) | ((yr == y - 1) & (mo == 12) & (m == 1)), F.lit("p"))
               .when((yr == y - 1) & (mo == m), F.lit("y")))
    tagged = g.select(period.alias("_p"), "GrossRevenueUSD", "EstimatedNetProfitUSD", "SalesOrderID",
                      "CustomerName").where(F.col("_p").isNotNull())
    per = tagged.groupBy("_p").agg(
        F.sum("GrossRevenueUSD").alias("rev"), F.sum("EstimatedNetProfitUSD").alias("prof"),
        count_distinct("SalesOrderID", approx).alias("orders"), count_distinct("CustomerName", approx).alias("cust"),
        F.avg("GrossRevenueUSD").alias("aov"))
    # pivot the (at most three) period rows into one row; a missing period
    # behaves like the reference's empty aggregate (NULL sums, 0 counts)
    one = per.agg(*[F.max(F.when(F.col("_p") == p, F.col(c))).alias(f"{p}_{c}")
                    for p in ("c", "p", "y") for c in ("rev", "prof", "orders", "cust", "aov")])
    c_rev, p_rev, y_rev = F.col("c_rev"), F.col("p_rev"), F.col("y_rev")
    c_prof, p_prof, y_prof = F.col("c_prof"), F.col("p_prof"), F.col("y_prof")
    c_cust = F.coalesce(F.col("c_cust"), F.lit(0)).cast("double")
    p_cust = F.coalesce(F.col("p_cust"), F.lit(0)).cast("double")
    c_aov, p_aov = F.col("c_aov"), F.col("p_aov")
    rev_g = safe_div(c_rev - p_rev, p_rev)
    prof_g = safe_div(c_prof - p_prof, p_prof)
    c_m, p_m, y_m = safe_div(c_prof, c_rev), safe_div(p_prof, p_rev), safe_div(y_prof, y_rev)
    cust_g = safe_div(c_cust - p_cust, p_cust)
    aov_g = safe_div(c_aov - p_aov, p_aov)
    null = F.lit(None).cast("double")
    rows = [
        ("Revenue (USD)", round_half_up(c_rev, 2), round_half_up(p_rev, 2), round_half_up(rev_g * 100, 2),
         round_half_up(safe_div(c_rev - y_rev, y_rev) * 100, 2), _ladder(rev_g, GROWTH_LADDER)),
        ("Profit (USD)", round_half_up(c_prof, 2), round_half_up(p_prof, 2), round_half_up(prof_g * 100, 2),
         round_half_up(safe_div(c_prof - y_prof, y_prof) * 100, 2), _ladder(prof_g, GROWTH_LADDER)),
        ("Profit Margin %", round_half_up(c_m * 100, 2), round_half_up(p_m * 100, 2),
         round_half_up((c_m - p_m) * 100, 2), round_half_up((c_m - y_m) * 100, 2), _ladder(c_m, MARGIN_LADDER)),
        ("Active Customers", c_cust, p_cust, round_half_up(cust_g * 100, 2), null,
         _ladder(cust_g, CUSTOMER_LADDER)),
        ("Average Order Value (USD)", round_half_up(c_aov, 2), round_half_up(p_aov, 2),
         round_half_up(aov_g * 100, 2), null, _ladder(aov_g, GROWTH_LADDER)),
    ]
    structs = [F.struct(F.lit(name).alias("Metric"), cur.cast("double").alias("Current_Value"),
                        pri.cast("double").alias("Prior_Period_Value"),
                        mom.cast("double").alias("MoM_Change_Pct"),
                        yoy.cast("double").alias("YoY_Change_Pct"), h.alias("Health_Status"))
               for name, cur, pri, mom, yoy, h in rows]
    return one.select(F.inline(F.array(*structs)))
