"""The dashboard's measure layer (F1-F65) as DataFrame plans.

A DAX measure is a scalar evaluated in a *filter context*.  Here a measure
family is evaluated for every member of a grain (``by`` columns) in one
aggregation; context modifiers become plan shapes:

* ``CALCULATE(m, <filter>)``          -> conditional aggregate ``sum(when(...))``
* ``ALL(col)`` / ``ALLEXCEPT(...)``   -> aggregate at the coarser grain, joined back
* ``ALLSELECTED(table)``              -> one global aggregate over the selection
                                         (a scalar subquery)
* ``DATEADD(-1, MONTH)`` / ``SAMEPERIODLASTYEAR`` / ``DATESINPERIOD`` at month
  grain -> row offsets on a *dense* month spine (every calendar month present),
  so a missing month is a BLANK, never a shifted neighbour
* ``DISTINCTCOUNT``                   -> COUNT(DISTINCT) + 1 if BLANK occurs
* ``DIVIDE(a, b, alt)``               -> ``functions.divide``

Only month (and year) grain is supported for the time-intelligence measures;
rows are the calendar months for which at least one base measure is
non-BLANK.  Calendar attributes (Year, Month, IsWeekend, ...) are pure
functions of ``OrderDate``, so the DateTable relationship is evaluated in
place (no join).
"""

from __future__ import annotations

from decimal import Decimal
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import day_diff, distinctcount_blank, divide, round_half_up
from ..operators.ranking import global_row_number
from ..operators.stats import join_group_stats, scalar
from .calendar import calendar_bounds
from .golden import latest_order_date

REV, PROF = "GrossRevenueUSD", "EstimatedNetProfitUSD"

# Measure labels and thresholds from the semantic model.
HEALTH_STATUS = [(5, "📈 Excellent Growth"), (0, "✅ Positive Growth"), (-5, "⚠️ Warning - Slight Decline")]
HEALTH_STATUS_ELSE = "🔴 Critical - Significant Decline"
FIXED_YEARS = (2022, 2023, 2024, 2025)
R_SCORE = [(30, 5), (90, 4), (180, 3), (365, 2)]          # days <= bound
F_SCORE = [(20, 5), (10, 4), (5, 3), (2, 2)]              # orders >= bound
M_SCORE = [(100000, 5), (50000, 4), (25000, 3), (10000, 2)]  # revenue >= bound
DAX_SEGMENTS = [
    ("Champions", (4, None), (4, None), (4, None)),
    ("Loyal Customers", (3, None), (3, None), (4, None)),
    ("Big Spenders", (4, None), (None, 2), (3, None)),
    ("At Risk", (None, 2), (3, None), (3, None)),
    ("Can't Lose Them", (None, 2), (4, None), (None, None)),
    ("Lost", (None, 2), (None, None), (None, None)),
]
DAX_SEGMENT_ELSE = "Regular"
PARETO_SHARE = Decimal("0.2")
LIFECYCLE_RECENT_DAYS = 180
LIFECYCLE_GROWTH = [(0.20, "Growth"), (0.05, "Mature/Stable"), (0, "Declining")]
LIFECYCLE_ELSE = "Stagnant/No Growth"
ORDER_SIZE = [(100, "Small (<$100)"), (500, "Medium ($100-$500)"), (2000, "Large ($500-$2K)")]
ORDER_SIZE_ELSE = "Extra Large (>$2K)"
DAX_DISCOUNT = [("0", "No Discount", "eq"), ("0.05", "Small (0-5%)", "le"),
                ("0.15", "Medium (5-15%)", "le"), ("0.30", "Large (15-30%)", "le")]
DAX_DISCOUNT_ELSE = "Very Large (>30%)"
FULFILLED_STATUS = "Shipped"
SCENARIO_MIN, SCENARIO_STEP, SCENARIO_STEPS = Decimal("-0.50"), Decimal("0.05"), 20
SCENARIO_LABELS = [(0.20, "🚀 Aggressive Growth"), (0.05, "📈 Optimistic"), (-0.05, "📊 Base Case"),
                   (-0.20, "⚠️ Conservative")]
SCENARIO_LABEL_ELSE = "🔴 Pessimistic"
CONFIDENCE = [(0.1, "🟢 High Confidence"), (0.3, "🟡 Medium Confidence")]
CONFIDENCE_ELSE = "🔴 Low Confidence"
TREND = [("1.10", "Strong Growth"), ("1.05", "Moderate Growth"), ("0.95", "Stable"), ("0.90", "Moderate Decline")]
TREND_ELSE = "Strong Decline"
Z_OUTLIER, Z_CRITICAL = 2, 3


def _ladder_gt(x: Column, ladder, default) -> Column:
    out = None
    for t, label in ladder:
        out = F.when(x > t, F.lit(label)) if out is None else out.when(x > t, F.lit(label))
    return out.otherwise(F.lit(default))


def _blank0(c: Column) -> Column:
    """DAX arithmetic treats BLANK as 0."""
    return F.coalesce(c, F.lit(0))


def _growth(cur: Column, prev: Column) -> Column:
    """DIVIDE(cur - prev, prev, 0) with BLANK arithmetic."""
    return divide(_blank0(cur) - _blank0(prev), prev, 0.0)


DATE_ROLES = {"order": "OrderDate", "ship": "ShipDate"}


def _dated(g: DataFrame, date_role: str = "order") -> DataFrame:
    """Fact rows related to the DateTable.  OrderDate is the active
    relationship; ``date_role='ship'`` evaluates through the inactive
    ShipDate relationship instead (USERELATIONSHIP).  Adds Year, Month and
    ``_Date`` (the role's date)."""
    d = F.col(DATE_ROLES[date_role])
    base = g.where(d.isNotNull())
    if date_role == "order":
        base = base.withColumnRenamed("OrderYear", "Year").withColumnRenamed("OrderMonth", "Month")
    else:
        base = base.withColumn("Year", F.year(d)).withColumn("Month", F.month(d))
    return base.withColumn("_Date", d)


def _keys_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` with NULL-safe equality (a BLANK member is a key)."""
    ren = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                       *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(ren[f"_r_{k}"]) for k in keys]
    return left.join(ren, cond, "left").drop(*[f"_r_{k}" for k in keys])


# ------------------------------------------------------------------ core
def core_measures(g: DataFrame, by: list[str]) -> DataFrame:
    """F1-F10 at the ``by`` grain.

    Distinct orders are counted by marking one line of each order and member:
    where a join left an order's lines together (or by a shuffle on the order
    elsewhere), they stay there.  Only customers and products are shuffled as
    groups, in two lanes of the line instead of Expand's four."""
    order, lane = F.col("SalesOrderID"), F.col("_lane") == 0
    first = F.row_number().over(Window.partitionBy(*by, "SalesOrderID").orderBy("SalesOrderID")) == 1
    rows = g.select(*by, "SalesOrderID", "CustomerID", "ProductName", REV, PROF, "OrderQty").withColumn("_first", first)
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_lane"))

    def n(c: Column) -> Column:
        return F.when(c, 1).otherwise(0)
    rows = rows.select(
        *by, "_lane", F.when(lane, F.col("CustomerID")).alias("_customer"), F.when(~lane, F.col("ProductName")).alias("_product"),
        F.when(lane, F.col(REV)).alias("_rev"), F.when(lane, F.col(PROF)).alias("_prof"),
        F.when(lane, F.col("OrderQty").cast("bigint")).alias("_qty"), n(lane & F.col("_first") & order.isNotNull()).alias("_order"),
        n(lane & order.isNull()).alias("_blank"), n(lane).alias("_line"), n(lane & F.col(REV).isNotNull()).alias("_value"))
    sums = ["_rev", "_prof", "_qty", "_order", "_line", "_value"]
    rows = rows.groupBy(*by, "_lane", "_customer", "_product").agg(*[F.sum(c).alias(c) for c in sums], F.max("_blank").alias("_blank"))

    def distinct(here: Column, value: str) -> Column:
        missing = F.col(value).isNull()
        return F.sum(n(here & ~missing)) + F.max(n(here & missing))
    a = rows.groupBy(*by).agg(
        F.sum("_rev").alias("TotalRevenue"), F.sum("_prof").alias("TotalProfit"),
        (F.sum("_order") + F.max("_blank")).alias("TotalOrders"), distinct(lane, "_customer").alias("TotalCustomers"),
        F.sum("_qty").alias("TotalQuantity"), distinct(~lane, "_product").alias("ProductCount"),
        F.sum("_line").alias("_rows"), F.sum("_value").alias("_n"))
    # The mean of decimals by whole part and remainder: their quotient keeps too few digits.
    total, count = F.col("TotalRevenue"), F.when(F.col("_n") > 0, F.col("_n"))
    rest = (total % count).cast("decimal(28,10)") / count.cast("decimal(18,0)")
    mean = F.call_function("div", total, count).cast("decimal(20,0)") + rest
    a = a.withColumn("_mean", mean.cast("decimal(38,10)"))
    return a.select(
        *by, "TotalRevenue", "TotalProfit", "TotalOrders", "TotalCustomers", "TotalQuantity", "ProductCount",
        round_half_up(divide("TotalProfit", "TotalRevenue", 0.0), 6).alias("ProfitMarginPct"),
        round_half_up(divide("TotalRevenue", "TotalOrders", 0.0), 6).alias("AvgOrderValue"),
        round_half_up(divide("TotalRevenue", "_rows", 0.0), 6).alias("AvgRevenuePerTransaction"),
        round_half_up("_mean", 6).alias("MeanRevenue"))


# ------------------------------------------------------------------ time
def _monthly(g: DataFrame, aggs: list[Column], date_role: str = "order",
             by: list[str] | None = None) -> DataFrame:
    """Monthly aggregates on the dense month spine (BLANK for empty months)."""
    by = by or []
    m = _dated(g, date_role).groupBy(*by, "Year", "Month").agg(*aggs)
    values = [c for c in m.columns if c not in (*by, "Year", "Month")]
    p = F.col("Year") * 12 + F.col("Month") - 1
    # One pass over the fact: a key's months (at most the calendar's) become a
    # map that is read at every calendar month.
    packed = m.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(
        p.alias("p"), F.struct(*values).alias("v")))).alias("_months"))
    b = calendar_bounds(g)
    months = F.explode(F.sequence(scalar(b, "start"), scalar(b, "end"), F.expr("interval 1 month")))
    at = packed.select(*by, "_months", months.alias("m")).select(
        *by, "_months", F.year("m").alias("Year"), F.month("m").alias("Month"),
        (F.year("m") * 12 + F.month("m") - 1).alias("p"))
    return at.select(*by, "Year", "Month", "p", *[F.col("_months")[F.col("p")][c].alias(c) for c in values])


def time_intelligence(g: DataFrame, fixed_years=FIXED_YEARS, date_role: str = "order",
                      by: list[str] | None = None, grain: str = "month") -> DataFrame:
    """F11-F21 at (``by`` keys, Year, Month) or, with ``grain='year'``, at
    (``by`` keys, Year).

    DATEADD / SAMEPERIODLASTYEAR shift every date in the filter context, so
    at year grain "previous month" is the year's months each shifted back one
    month (December of the prior year plus January-November) and "same
    period last year" is the prior year: both are sums of the monthly shifted
    values.  The window over the dense spine is partitioned by the ``by``
    keys; each partition holds one row per calendar month.
    """
    if grain not in ("month", "year"):
        raise ValueError(f"time intelligence supports month or year grain, not {grain!r}")
    by = by or []
    base = _monthly(g, [F.sum(REV).alias("TotalRevenue"), F.sum(PROF).alias("TotalProfit")], date_role, by)
    w = Window.partitionBy(*by).orderBy("p") if by else Window.orderBy("p")
    t = base.select("*", F.lag("TotalRevenue", 1).over(w).alias("PMRevenue"),
                    F.lag("TotalRevenue", 12).over(w).alias("PYRevenue"),
                    F.lag("TotalProfit", 1).over(w).alias("PMProfit"))
    period = ["Year", "Month"]
    if grain == "year":
        t = t.groupBy(*by, "Year").agg(*[F.sum(c).alias(c) for c in
                                         ("TotalRevenue", "TotalProfit", "PMRevenue", "PYRevenue", "PMProfit")])
        period = ["Year"]
    # CALCULATE([Total Revenue], DateTable[Year] = k) replaces the Year filter
    # and keeps the others (the Month filter at month grain): over the dense
    # periods, whose number per key is that of the calendar.
    keep = Window.partitionBy(*by, "Month") if grain == "month" else Window.partitionBy(*by)
    t = t.select("*", *[F.sum(F.when(F.col("Year") == k, F.col("TotalRevenue"))).over(keep).alias(f"Revenue{k}")
                        for k in fixed_years])
    mom = _growth(F.col("TotalRevenue"), F.col("PMRevenue"))
    return (t.where(F.col("TotalRevenue").isNotNull() | F.col("PMRevenue").isNotNull()
                    | F.col("PYRevenue").isNotNull())
             .select(*by, *period, "TotalRevenue", "TotalProfit", "PMRevenue", "PYRevenue", "PMProfit",
                     round_half_up(mom, 6).alias("MoMGrowthPct"),
                     round_half_up(_growth(F.col("TotalRevenue"), F.col("PYRevenue")), 6).alias("YoYGrowthPct"),
                     round_half_up(_growth(F.col("TotalProfit"), F.col("PMProfit")), 6).alias("MoMProfitGrowthPct"),
                     _ladder_gt(mom, HEALTH_STATUS, HEALTH_STATUS_ELSE).alias("HealthStatus"),
                     *[F.col(f"Revenue{k}") for k in fixed_years]))


def moving_averages(g: DataFrame, date_role: str = "order", by: list[str] | None = None,
                    grain: str = "month") -> DataFrame:
    """F22-F23: revenue over the trailing 3 / 6 calendar months ÷ 3 / 6.

    DATESINPERIOD starts from LASTDATE of the context, so at year grain the
    window is the year's last 3 / 6 calendar months (the December row of the
    month spine)."""
    if grain not in ("month", "year"):
        raise ValueError(f"moving averages support month or year grain, not {grain!r}")
    by = by or []
    base = _monthly(g, [F.sum(REV).alias("TotalRevenue")], date_role, by)
    w = Window.partitionBy(*by).orderBy("p") if by else Window.orderBy("p")
    s3 = F.sum("TotalRevenue").over(w.rowsBetween(-2, 0))
    s6 = F.sum("TotalRevenue").over(w.rowsBetween(-5, 0))
    t = base.select(*by, "Year", "Month", "TotalRevenue", (s3 / 3).alias("_ma3"), (s6 / 6).alias("_ma6"))
    period = ["Year", "Month"]
    if grain == "year":
        year_rev = base.groupBy(*by, "Year").agg(F.sum("TotalRevenue").alias("TotalRevenue"))
        dec = t.where(F.col("Month") == 12).select(*by, "Year", "_ma3", "_ma6")
        t = _keys_join(year_rev, dec, [*by, "Year"])
        period = ["Year"]
    return (t.where(F.col("_ma3").isNotNull() | F.col("_ma6").isNotNull())
             .select(*by, *period, "TotalRevenue", round_half_up("_ma3", 6).alias("MA3Month"),
                     round_half_up("_ma6", 6).alias("MA6Month")))


# ------------------------------------------------------------------ customer
def customer_measures(g: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F4, F25, F26, F27 at (``by`` keys, Year, Month).

    Retention: customers of month t that also bought in t-1, over customers
    of t-1 (INTERSECT of the two VALUES sets, BLANK included).  A customer's
    months (at most the calendar's) are gathered once; each month looks for
    the one before among them, so the fact is read in one pass.
    """
    by = by or []
    gmax = latest_order_date(g)
    p = (F.col("Year") * 12 + F.col("Month") - 1).alias("p")
    cm = _dated(g).groupBy(*by, "Year", "Month", "CustomerID").agg(
        distinctcount_blank("SalesOrderID").alias("o"), F.max("OrderDate").alias("d"))
    own = cm.groupBy(*by, "CustomerID").agg(F.collect_list(F.struct(p, "o", "d")).alias("_own"))
    seen = own.select(*by, F.col("_own.p").alias("_ps"), F.inline("_own"))
    cur = seen.groupBy(*by, "p").agg(
        F.count(F.lit(1)).alias("TotalCustomers"), F.sum((F.col("o") > 1).cast("int")).alias("_repeat"),
        F.sum(F.array_contains("_ps", F.col("p") - 1).cast("int")).alias("_kept"), F.max("d").alias("_last"))
    packed = cur.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(
        "p", F.struct("TotalCustomers", "_repeat", "_kept", "_last")))).alias("_months"))
    b = calendar_bounds(g)
    months = F.explode(F.sequence(scalar(b, "start"), scalar(b, "end"), F.expr("interval 1 month")))
    t = packed.select(*by, "_months", months.alias("m")).select(
        *by, F.year("m").alias("Year"), F.month("m").alias("Month"),
        F.col("_months")[F.year("m") * 12 + F.month("m") - 1].alias("v"),
        F.col("_months")[F.year("m") * 12 + F.month("m") - 2]["TotalCustomers"].alias("_prev_n"))
    t = t.select(*by, "Year", "Month", "v.TotalCustomers", "v._repeat", "v._last", "_prev_n",
                 F.when(F.col("v._kept") > 0, F.col("v._kept")).alias("_retained"))
    return (t.where(F.col("TotalCustomers").isNotNull() | F.col("_prev_n").isNotNull())
             .select(*by, "Year", "Month", "TotalCustomers",
                     round_half_up(divide(_blank0(F.col("_retained")), "_prev_n", 0.0), 6).alias("RetentionRate"),
                     round_half_up(divide("_repeat", "TotalCustomers", 0.0), 6).alias("RepeatCustomerPct"),
                     day_diff(F.col("_last"), gmax).alias("DaysSinceLastOrder")))


def _score(x: Column, ladder, cmp: str) -> Column:
    out = None
    for bound, s in ladder:
        cond = (x <= bound) if cmp == "le" else (x >= bound)
        out = F.when(cond, F.lit(s)) if out is None else out.when(cond, F.lit(s))
    return out.otherwise(F.lit(1))


def rfm_scores(days: Column, orders: Column, revenue: Column) -> tuple[Column, Column, Column]:
    """F28-F30 from a customer's days since the last order, orders and revenue."""
    return (_score(_blank0(days), R_SCORE, "le"), _score(_blank0(orders), F_SCORE, "ge"),
            _score(_blank0(revenue), M_SCORE, "ge"))


def _segment(scores: tuple[int, int, int]) -> str:
    for name, *bounds in DAX_SEGMENTS:
        if all((lo is None or x >= lo) and (hi is None or x <= hi) for x, (lo, hi) in zip(scores, bounds, strict=True)):
            return name
    return DAX_SEGMENT_ELSE


def dax_segment(r: Column, f: Column, m: Column) -> Column:
    """F31 from the three scores: looked up by their combination, as a CASE of
    the rules repeats each score's CASE in every rule, which made a method
    larger than the JVM compiles."""
    names = [_segment(scores) for scores in product(range(1, 6), repeat=3)]
    return F.get(F.array(*[F.lit(n) for n in names]), (r - 1) * 25 + (f - 1) * 5 + (m - 1))


def rfm_columns(g: DataFrame) -> DataFrame:
    """F24, F28-F31 per CustomerID (the calculated columns are constant per
    customer): R/F/M scores, segment and lifetime value."""
    gmax = latest_order_date(g)
    c = g.groupBy("CustomerID").agg(F.max("OrderDate").alias("_last"),
                                    distinctcount_blank("SalesOrderID").alias("_orders"),
                                    F.sum(REV).alias("CustomerLTV"))
    days = day_diff(F.col("_last"), gmax)
    r, f, m = rfm_scores(days, F.col("_orders"), F.col("CustomerLTV"))
    s = c.select("CustomerID", r.alias("RScore"), f.alias("FScore"), m.alias("MScore"), "CustomerLTV",
                 days.alias("DaysSinceLastOrder"))
    return s.select("*", dax_segment(F.col("RScore"), F.col("FScore"), F.col("MScore")).alias("CustomerSegment"))


LTV_KEPT = ["CustomerID", "CustomerSegment", "Year", "CustomerName"]


def customer_ltv(g: DataFrame, by: list[str]) -> DataFrame:
    """F24 Customer LTV at the ``by`` grain.

    ``CALCULATE([Total Revenue], ALLEXCEPT(fact, CustomerID, Customer Segment,
    DateTable[Year], CustomerName))`` drops every filter but those on the kept
    columns, so the value is the revenue at the grain ``by ∩ kept``, shown on
    every ``by`` row.  The segment (a per-customer calculated column) is
    joined to lines pre-aggregated per (customer, by) — never to raw lines.
    """
    keys = ["CustomerID"] + [c for c in by if c not in ("CustomerID", "CustomerSegment")]
    base = g.select("*", F.col("OrderYear").alias("Year")).groupBy(*keys).agg(F.sum(REV).alias("_rev"))
    if "CustomerSegment" in by:
        seg = rfm_columns(g).select(F.col("CustomerID").alias("_cid"), "CustomerSegment")
        base = base.join(seg, base.CustomerID.eqNullSafe(seg._cid), "left").drop("_cid")
    vis = base.groupBy(*by).agg(F.sum("_rev").alias("TotalRevenue"))
    kept = [c for c in by if c in LTV_KEPT]
    out = join_group_stats(vis, kept, [F.sum("TotalRevenue").alias("CustomerLTV")])
    return out.select(*by, "TotalRevenue", "CustomerLTV")


# ------------------------------------------------------------------ product
def product_measures(g: DataFrame, by: list[str] = ["CategoryName"]) -> DataFrame:
    """F32, F33 per (by, ProductName): contribution within the ``by`` group
    (ALL(ProductName) keeps the other filters) and velocity."""
    p = g.groupBy(*by, "ProductName").agg(
        F.sum(REV).alias("TotalRevenue"), F.sum(F.col("OrderQty").cast("bigint")).alias("_qty"),
        distinctcount_blank("SalesOrderID").alias("_orders"))
    j = join_group_stats(p, by, [F.sum("TotalRevenue").alias("_grp_total")])
    return j.select(*by, "ProductName", "TotalRevenue",
                    round_half_up(divide("TotalRevenue", "_grp_total", 0.0), 6).alias("ProductContributionPct"),
                    round_half_up(divide("_qty", "_orders", 0.0), 6).alias("ProductVelocity"))


def pareto(g: DataFrame, by: list[str] = ["CategoryName"]) -> DataFrame:
    """F6, F34, F35 per ``by`` group: revenue of the top ROUNDUP(20% × product
    count) products, ties at the boundary included (TOPN semantics: every
    product whose revenue reaches the N-th highest revenue of its group).

    No window holds a group's products: products get one global row number
    over (group, revenue desc, name) from the range-partitioned rank; each
    group's first row number and size locate its N-th row, whose revenue is
    the group's threshold.  Everything else is grouped aggregation and joins.
    """
    if not by:
        return pareto(g.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    return top_products(g.groupBy(*by, "ProductName").agg(F.sum(REV).alias("_rev")), by)


def top_products(p: DataFrame, by: list[str]) -> DataFrame:
    """F6, F34, F35 from the revenue (``_rev``) of each product of a group."""
    order = [*[F.col(k).asc_nulls_first() for k in by], F.col("_rev").desc_nulls_last(),
             F.col("ProductName").asc_nulls_first()]
    ranked = global_row_number(p, order, "_rn").drop("_rn_total")
    grp = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("ProductCount"), F.sum("_rev").alias("TotalRevenue"),
        F.min("_rn").alias("_first"))
    nth = F.col("_first") - 1 + F.ceil(F.col("ProductCount").cast("decimal(20,0)") * F.lit(PARETO_SHARE))
    grp = grp.select("*", nth.cast("bigint").alias("_nth"))
    grp = grp.join(ranked.select(F.col("_rn").alias("_nth"), F.col("_rev").alias("_threshold")), "_nth", "left")
    thr = grp.select(*[F.col(k).alias(f"_g_{k}") for k in by], "_threshold")
    t = p.join(thr, [p[k].eqNullSafe(thr[f"_g_{k}"]) for k in by], "left")
    top = t.groupBy(*by).agg(
        F.sum(F.when(F.col("_rev") >= F.col("_threshold"), F.col("_rev"))).alias("Top20ProductsRevenue"))
    top = top.select(*[F.col(k).alias(f"_t_{k}") for k in by], "Top20ProductsRevenue")
    a = grp.join(top, [grp[k].eqNullSafe(top[f"_t_{k}"]) for k in by], "left")
    return a.select(*by, "ProductCount", "TotalRevenue", "Top20ProductsRevenue",
                    round_half_up(divide("Top20ProductsRevenue", "TotalRevenue", 0.0) * 100, 6).alias("ParetoRatio"))


def _product_sums(g: DataFrame) -> list[Column]:
    """First / last order date, revenue, and revenue before the calendar's
    last year."""
    last_cal_year = scalar(calendar_bounds(g).select(F.year("end").alias("y")), "y")
    return [F.min("OrderDate").alias("_first"), F.max("OrderDate").alias("_lastd"), F.sum(REV).alias("_tr"),
            F.sum(F.when(F.col("OrderYear") < last_cal_year, F.col(REV))).alias("_py")]


def product_growth(g: DataFrame) -> DataFrame:
    """Per ProductName: first / last order date, revenue, and YoY Growth %
    with only the ProductName filter kept and no date filter: this year's set
    is the whole calendar, last year's set is the calendar shifted back one
    year clipped to the calendar, i.e. every calendar year but the last."""
    p = g.groupBy("ProductName").agg(*_product_sums(g))
    return p.select("*", _growth(F.col("_tr"), F.col("_py")).alias("_growth"))


def lifecycle_stage(g: DataFrame) -> DataFrame:
    """F36 calculated column, summarised per (ProductName, ProductStatus,
    stage) with line counts (the status is a row attribute)."""
    ref = latest_order_date(g)
    # One pass over the fact; a product's statuses are a few rows.
    rows = g.groupBy("ProductName", "ProductStatus").agg(F.count(F.lit(1)).alias("Lines"), *_product_sums(g))
    of = Window.partitionBy("ProductName")
    j = rows.select("ProductName", "ProductStatus", "Lines", F.min("_first").over(of).alias("_first"),
                    F.max("_lastd").over(of).alias("_lastd"), F.sum("_tr").over(of).alias("_tr"),
                    F.sum("_py").over(of).alias("_py"))
    growth = _growth(F.col("_tr"), F.col("_py"))
    since_first, since_last = day_diff(F.col("_first"), ref), day_diff(F.col("_lastd"), ref)
    disc = F.col("ProductStatus") == "Discontinued"
    stage = (F.when(disc & (since_last > LIFECYCLE_RECENT_DAYS), F.lit("Obsolete"))
              .when(disc, F.lit("Phasing Out"))
              .when(since_first < LIFECYCLE_RECENT_DAYS, F.lit("New/Launch")))
    for t, label in LIFECYCLE_GROWTH:
        stage = stage.when(growth > t, F.lit(label))
    return j.select("ProductName", "ProductStatus", stage.otherwise(F.lit(LIFECYCLE_ELSE)).alias("ProductLifecycleStage"),
                    "Lines")


# ------------------------------------------------------------------ operations
def order_online(c="IsOnlineOrder") -> Column:
    return F.when(F.col(c) == F.lit(True), F.lit("Online")).otherwise(F.lit("Offline"))


def order_size_bucket(c=REV) -> Column:
    x = F.col(c)
    out = None
    for t, label in ORDER_SIZE:
        out = F.when(x < t, F.lit(label)) if out is None else out.when(x < t, F.lit(label))
    return out.otherwise(F.lit(ORDER_SIZE_ELSE))


def dax_discount_bucket(c="UnitPriceDiscount") -> Column:
    x = _blank0(F.col(c))
    out = None
    for t, label, op in DAX_DISCOUNT:
        cond = (x == F.lit(Decimal(t))) if op == "eq" else (x <= F.lit(Decimal(t)))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(DAX_DISCOUNT_ELSE))


def operations_measures(g: DataFrame, by: list[str] = ["TerritoryName"]) -> DataFrame:
    """F37-F41, F45 at the ``by`` grain.

    ``DateTable`` is not filtered by fact columns, so Orders per Day divides
    by all calendar days, while Avg Orders per Day averages the days that
    have orders (AVERAGEX skips BLANK)."""
    cal_days = scalar(calendar_bounds(g).select((F.datediff("end", "start") + 1).alias("n")), "n")
    if not by:
        return operations_measures(g.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    a = g.groupBy(*by).agg(
        F.avg("DaysToShip").alias("_proc"),
        distinctcount_blank("SalesOrderID").alias("TotalOrders"),
        F.sum(F.col("OrderQty").cast("bigint")).alias("_qty"),
        # DISTINCTCOUNT over the shipped rows: a BLANK order counts once.
        (F.countDistinct(F.when(F.col("OrderStatus") == FULFILLED_STATUS, F.col("SalesOrderID")))
         + F.coalesce(F.max((F.col("SalesOrderID").isNull() & (F.col("OrderStatus") == FULFILLED_STATUS)).cast("int")),
                      F.lit(0))).alias("_shipped"),
        F.avg("UnitPriceDiscount").alias("_disc"))
    daily = (_dated(g).groupBy(*by, "OrderDate").agg(distinctcount_blank("SalesOrderID").alias("_n"))
                      .groupBy(*by).agg(F.avg("_n").alias("_per_day")))
    j = a.join(daily, [a[k].eqNullSafe(daily[k]) for k in by], "left").select(
        *[a[k] for k in by], *[c for c in a.columns if c not in by], "_per_day")
    return j.select(*by, "TotalOrders",
                    round_half_up("_proc", 6).alias("AvgProcessingDays"),
                    round_half_up("_per_day", 6).alias("AvgOrdersPerDay"),
                    round_half_up(divide("_qty", "TotalOrders", 0.0), 6).alias("AvgItemsPerOrder"),
                    round_half_up(divide("_shipped", "TotalOrders", 0.0), 6).alias("OrderFulfillmentRate"),
                    round_half_up(divide("TotalOrders", cal_days, 0.0), 6).alias("OrdersPerDay"),
                    round_half_up("_disc", 6).alias("AvgDiscountPct"))


def bucket_columns(g: DataFrame) -> DataFrame:
    """F42-F44 calculated columns, summarised (lines and revenue per bucket)."""
    return (g.groupBy(order_online().alias("OrderOnline"), order_size_bucket().alias("OrderSizeBucket"),
                      dax_discount_bucket().alias("DiscountBucket"))
             .agg(F.count(F.lit(1)).alias("Lines"), F.sum(REV).alias("TotalRevenue")))


# ------------------------------------------------------------------ anomaly
def anomaly_measures(g: DataFrame, by: list[str] = ["CategoryName"]) -> DataFrame:
    """F47-F56 at the ``by`` grain; ALLSELECTED = the whole input (selection).

    Row-level z-scores (inside FILTER, context transition to one row) use the
    row's own revenue against the selection mean and population deviation."""
    sel = g.agg(F.avg(REV).alias("mu"), F.stddev_pop(REV).alias("sd"))
    mu, sd = scalar(sel, "mu"), scalar(sel, "sd")
    zr = divide(_blank0(F.col(REV)).cast("double") - mu, sd, 0.0)
    az = F.abs(zr)
    a = g.groupBy(*by).agg(
        F.avg(REV).alias("_avg"), F.var_pop(REV).alias("_var"), F.count(F.lit(1)).alias("_rows"),
        F.sum((az > Z_OUTLIER).cast("int")).alias("CountOfOutliers"),
        F.sum((zr > Z_OUTLIER).cast("int")).alias("PositiveOutliers"),
        F.sum((zr < -Z_OUTLIER).cast("int")).alias("NegativeOutliers"),
        F.sum((az > Z_CRITICAL).cast("int")).alias("AlertCritical"),
        F.sum(((az > Z_OUTLIER) & (az <= Z_CRITICAL)).cast("int")).alias("AlertWarning"),
        F.sum((az <= Z_OUTLIER).cast("int")).alias("AlertNormal"))
    return a.select(*by,
                    round_half_up(sd, 6).alias("RevenueStdDev"),
                    round_half_up("_var", 4).alias("RevenueVariance"),
                    round_half_up(divide(_blank0(F.col("_avg")).cast("double") - mu, sd, 0.0), 6).alias("RevenueZScore"),
                    "CountOfOutliers",
                    round_half_up(divide("CountOfOutliers", "_rows", 0.0), 6).alias("OutlierPctOfTotal"),
                    "PositiveOutliers", "NegativeOutliers", "AlertCritical", "AlertWarning", "AlertNormal")


# ------------------------------------------------------------------ forecast
def scenario_series() -> list[Decimal]:
    """A6 / F65: the what-if parameter values (exact decimals)."""
    return [SCENARIO_MIN + SCENARIO_STEP * i for i in range(SCENARIO_STEPS + 1)]


def scenario_label(s: Column) -> Column:
    return _ladder_gt(s, SCENARIO_LABELS, SCENARIO_LABEL_ELSE)


def _trend(cur: Column, ma: Column) -> Column:
    out = None
    for mult, label in TREND:
        cond = _blank0(cur) > _blank0(ma) * float(mult)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(TREND_ELSE))


def forecast_measures(g: DataFrame, scenario: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """F57, F60-F62 at (``by`` keys, Year, Month) for one scenario value."""
    by = by or []
    sel_sd = scalar(g.agg(F.stddev_pop(REV).alias("sd")), "sd")
    base = _monthly(g, [F.sum(REV).alias("TotalRevenue"), F.avg(REV).alias("_mean"),
                        F.stddev_pop(PROF).alias("_psd"), F.avg(PROF).alias("_pmean")], by=by)
    w = Window.partitionBy(*by).orderBy("p")
    t = base.select("*", F.lag("TotalRevenue", 1).over(w).alias("_pm"),
                    (F.sum("TotalRevenue").over(w.rowsBetween(-5, 0)) / 6).alias("_ma6"))
    mom = _growth(F.col("TotalRevenue"), F.col("_pm"))
    vol = F.try_divide(sel_sd, F.col("_mean").cast("double"))
    conf = F.when(vol < 0.1, F.lit(CONFIDENCE[0][1])).when(vol < 0.3, F.lit(CONFIDENCE[1][1])) \
            .otherwise(F.lit(CONFIDENCE_ELSE))
    return (t.where(F.col("TotalRevenue").isNotNull() | F.col("_ma6").isNotNull())
             .select(*by, "Year", "Month", "TotalRevenue",
                     round_half_up("_ma6", 6).alias("MA6Month"),
                     round_half_up(mom, 6).alias("MoMGrowthPct"),
                     round_half_up(F.col("_ma6").cast("double") * (1 + mom + scenario), 4).alias("ForecastNextMonth"),
                     round_half_up(F.try_divide(F.col("_psd"), F.col("_pmean").cast("double")), 6).alias("ProfitVolatility"),
                     conf.alias("ForecastConfidence"),
                     _trend(F.col("TotalRevenue"), F.col("_ma6")).alias("TrendDirection")))


def scenario_card(g: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F57-F59 as cards (no date filter) for every what-if scenario value,
    optionally for each member of the ``by`` columns.

    With no date filter: PM revenue is every sale up to the end of the
    calendar's second-to-last month (DATEADD of the full calendar), MA6 is
    the calendar's last six months ÷ 6, and the projection scales the last
    data month's revenue to a full month (the last date of the whole record).
    """
    by = by or []
    b = calendar_bounds(g)
    end = scalar(b, "end")
    last = latest_order_date(g)
    start_m = F.trunc(last, "month")
    a = g.groupBy(*by).agg(
        F.sum(REV).alias("_tr"),
        F.sum(F.when(F.col("OrderDate") <= F.last_day(F.add_months(end, -1)), F.col(REV))).alias("_pm"),
        F.sum(F.when(F.col("OrderDate") > F.add_months(end, -6), F.col(REV))).alias("_ma6sum"),
        F.sum(F.when((F.col("OrderDate") >= start_m) & (F.col("OrderDate") <= last), F.col(REV))).alias("_lm"))
    mom = _growth(F.col("_tr"), F.col("_pm"))
    days_in = F.datediff(last, start_m) + 1
    full = F.dayofmonth(F.last_day(last))
    norm = divide("_lm", days_in) * full
    s = F.col("ScenarioValue")
    series = F.array(*[F.lit(v) for v in scenario_series()])
    return (a.select("*", F.explode(series).alias("ScenarioValue"))
             .select(*by, F.col("ScenarioValue").cast("double").alias("ScenarioValue"),
                     scenario_label(s).alias("ScenarioLabel"),
                     round_half_up(mom, 6).alias("MoMGrowthPct"),
                     round_half_up((F.col("_ma6sum") / 6).cast("double") * (1 + mom + s.cast("double")), 4)
                     .alias("ForecastNextMonth"),
                     round_half_up(norm * (1 + mom + s.cast("double")), 0).alias("RevenueProjection")))


# ------------------------------------------------------------------ seasonality
def seasonal_index(g: DataFrame, date_role: str = "order", by: list[str] | None = None) -> DataFrame:
    """F63 at (``by`` keys, Year, MonthName): month revenue ÷ mean revenue of that year's
    months with sales (AVERAGEX over month names skips BLANK)."""
    by = by or []
    m = (_dated(g, date_role).groupBy(*by, "Year", "Month", F.date_format("_Date", "MMMM").alias("MonthName"))
                  .agg(F.sum(REV).alias("TotalRevenue")))
    # a year has twelve months at most
    j = m.select("*", F.avg("TotalRevenue").over(Window.partitionBy(*by, "Year")).alias("_avg"))
    return j.select(*by, "Year", "Month", "MonthName", "TotalRevenue",
                    round_half_up(divide("TotalRevenue", "_avg"), 6).alias("SeasonalIndex"))


def weekpart_revenue(g: DataFrame, date_role: str = "order", by: list[str] | None = None) -> DataFrame:
    """F64a/b by (``by`` keys, Year): revenue on weekdays vs weekend days (DateTable[IsWeekend])."""
    wk = F.dayofweek("_Date").isin(1, 7)
    return (_dated(g, date_role).groupBy(*(by or []), "Year")
                     .agg(F.sum(F.when(~wk, F.col(REV))).alias("WeekdayRevenue"),
                          F.sum(F.when(wk, F.col(REV))).alias("WeekendRevenue")))


def territory_growth_rank(g: DataFrame) -> DataFrame:
    """F15 + F46 at (Year, TerritoryName): YoY growth per territory and its
    dense rank over all territories of that year (RANKX over ALL)."""
    d = _dated(g)
    b = calendar_bounds(g)
    y0, y1 = scalar(b, "start"), scalar(b, "end")
    # dense (year x territory) spine: each territory exploded over the
    # calendar years (rows bounded by territories x calendar years)
    spine = d.select("TerritoryName").distinct().select(
        "TerritoryName", F.explode(F.sequence(F.year(y0), F.year(y1))).alias("Year"))
    ty = d.groupBy("Year", "TerritoryName").agg(F.sum(REV).alias("TotalRevenue"))
    t = spine.join(ty, [spine.Year == ty.Year, spine.TerritoryName.eqNullSafe(ty.TerritoryName)], "left") \
             .select(spine.Year, spine.TerritoryName, ty.TotalRevenue)
    prev = t.select((F.col("Year") + 1).alias("Year"), F.col("TerritoryName").alias("_t"),
                    F.col("TotalRevenue").alias("PYRevenue"))
    t = t.join(prev, [t.Year == prev.Year, t.TerritoryName.eqNullSafe(prev._t)], "left") \
         .select(t.Year, t.TerritoryName, t.TotalRevenue, "PYRevenue")
    yoy = _growth(F.col("TotalRevenue"), F.col("PYRevenue"))
    t = t.select("*", yoy.alias("_yoy"), round_half_up(yoy, 6).alias("YoYGrowthPct"))
    rank = F.dense_rank().over(Window.partitionBy("Year").orderBy(F.col("_yoy").desc()))
    return (t.select("*", rank.alias("TerritoryGrowthRank"))
             .where(F.col("TotalRevenue").isNotNull() | F.col("PYRevenue").isNotNull())
             .drop("_yoy"))
