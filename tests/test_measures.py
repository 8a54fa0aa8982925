"""DAX measure semantics on tiny golden fixtures."""

from helpers import golden_df, line
from pyspark.sql import functions as F

from ledgerframe.functions import distinctcount_blank, round_half_up
from ledgerframe.plans import measures as M


def _by_month(df):
    return {(r.Year, r.Month): r for r in df.collect()}


def test_time_intelligence_blank_months(spark):
    g = golden_df(spark, [line(1, "2020-01-10", revenue="100"), line(2, "2020-03-10", revenue="150")])
    t = _by_month(M.time_intelligence(g))
    assert set(t) == {(2020, 1), (2020, 2), (2020, 3), (2020, 4)}     # rows with TR, PM or PY
    assert t[(2020, 2)].TotalRevenue is None and t[(2020, 2)].PMRevenue == 100
    assert t[(2020, 2)].MoMGrowthPct == -1.0                          # (BLANK - 100) / 100
    assert t[(2020, 3)].PMRevenue is None and t[(2020, 3)].MoMGrowthPct == 0.0   # DIVIDE alternate
    assert t[(2020, 3)].HealthStatus == "⚠️ Warning - Slight Decline"
    assert t[(2020, 1)].Revenue2022 is None


def test_moving_average_divides_by_window_length(spark):
    g = golden_df(spark, [line(1, "2020-01-10", revenue="100"), line(2, "2020-03-10", revenue="150")])
    t = _by_month(M.moving_averages(g))
    assert t[(2020, 3)].MA3Month == round(250 / 3, 6)
    assert t[(2020, 1)].MA3Month == round(100 / 3, 6)


def test_retention_and_repeat(spark):
    rows = [line(1, "2020-01-05", customer_id=1), line(2, "2020-01-06", customer_id=2),
            line(3, "2020-01-07", customer_id=2), line(4, "2020-02-05", customer_id=1),
            line(5, "2020-03-05", customer_id=2)]
    t = _by_month(M.customer_measures(golden_df(spark, rows)))
    assert t[(2020, 1)].TotalCustomers == 2 and t[(2020, 1)].RepeatCustomerPct == 0.5
    assert t[(2020, 2)].RetentionRate == 0.5
    assert t[(2020, 3)].RetentionRate == 0.0
    assert t[(2020, 4)].TotalCustomers is None and t[(2020, 4)].RetentionRate == 0.0


def test_pareto_topn_keeps_ties(spark):
    rows = [line(i, "2020-01-01", product=p, revenue=r)
            for i, (p, r) in enumerate([("a", "100"), ("b", "100"), ("c", "50"), ("d", "10"), ("e", "5")])]
    r = M.pareto(golden_df(spark, rows), ["CategoryName"]).first()
    assert (r.ProductCount, float(r.Top20ProductsRevenue)) == (5, 200.0)   # N = 1, tie at the boundary kept
    rows[1]["GrossRevenueUSD"] = rows[1]["GrossRevenueUSD"] / 2
    r = M.pareto(golden_df(spark, rows), ["CategoryName"]).first()
    assert float(r.Top20ProductsRevenue) == 100.0


def test_rfm_score_boundaries(spark):
    rows = [line(1, "2020-12-31", customer_id=1, revenue="100000"),              # max date
            line(2, "2020-12-01", customer_id=2, revenue="99999.99"),            # 30 days
            line(3, "2020-11-30", customer_id=3, revenue="10000"),               # 31 days
            line(4, "2019-12-31", customer_id=4, revenue="1")]                   # 366 days
    s = {r.CustomerID: r for r in M.rfm_columns(golden_df(spark, rows)).collect()}
    assert [s[i].RScore for i in (1, 2, 3, 4)] == [5, 5, 4, 1]
    assert [s[i].MScore for i in (1, 2, 3, 4)] == [5, 4, 2, 1]
    assert s[1].CustomerSegment == "Lost" or s[1].FScore == 1


def test_order_buckets(spark):
    rows = [line(1, "2020-01-01", revenue="99.99", discount="0"), line(2, "2020-01-01", revenue="100", discount="0.05"),
            line(3, "2020-01-01", revenue="2000", discount="0.31")]
    b = {(r.OrderSizeBucket, r.DiscountBucket) for r in M.bucket_columns(golden_df(spark, rows)).collect()}
    assert b == {("Small (<$100)", "No Discount"), ("Medium ($100-$500)", "Small (0-5%)"),
                 ("Extra Large (>$2K)", "Very Large (>30%)")}


def test_ship_date_role(spark):
    g = golden_df(spark, [line(1, "2020-01-30", revenue="100")])          # ships 2020-02-02
    by_order = _by_month(M.time_intelligence(g))
    by_ship = _by_month(M.time_intelligence(g, date_role="ship"))
    assert by_order[(2020, 1)].TotalRevenue == 100 and (2020, 1) not in by_ship   # no BLANK-only rows
    assert by_ship[(2020, 2)].TotalRevenue == 100


def test_customer_ltv_keeps_only_listed_filters(spark):
    rows = [line(1, "2020-01-01", customer_id=1, category="A", revenue="10"),
            line(2, "2020-01-01", customer_id=1, category="B", revenue="30")]
    out = {r.CategoryName: r for r in M.customer_ltv(golden_df(spark, rows), ["CustomerID", "CategoryName"]).collect()}
    assert (float(out["A"].TotalRevenue), float(out["A"].CustomerLTV)) == (10.0, 40.0)


def test_year_grain_shifts_each_date(spark):
    import pytest
    g = golden_df(spark, [line(1, "2019-12-10", revenue="10"), line(2, "2020-01-10", revenue="100"),
                          line(3, "2020-12-10", revenue="1000")])
    t = {r.Year: r for r in M.time_intelligence(g, grain="year").collect()}
    assert float(t[2020].TotalRevenue) == 1100.0
    assert float(t[2020].PMRevenue) == 110.0            # Dec 2019 + Jan..Nov 2020
    assert float(t[2020].PYRevenue) == 10.0
    with pytest.raises(ValueError):
        M.time_intelligence(g, grain="quarter")


def test_core_measures_count_without_expand(spark):
    """F8: values, distinct orders, customers and products with BLANKs, an order
    of two customers and members, an empty selection; no Expand."""
    rows = [line(1, "2000-01-01", "P1", category="A", customer_id=1, revenue="10", qty=2),
            line(1, "2000-01-01", "P2", category="A", customer_id=2, revenue="20"),
            line(1, "2000-01-01", "P1", category="B", customer_id=1, revenue="5"),
            line(None, "2000-01-02", None, category="A", customer_id=None, revenue="7"),
            line(None, "2000-01-02", None, category="A", customer_id=None, revenue="-40"),
            line(2, "2000-01-03", "P1", category=None, customer_id=1, revenue="1")]
    rows.append(dict(line(3, "2000-01-04", "P3", category="C"), GrossRevenueUSD=None, EstimatedNetProfitUSD=None))
    g = golden_df(spark, rows)
    out = M.core_measures(g, ["CategoryName"])
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    plain = g.groupBy("CategoryName").agg(
        F.sum(M.REV), F.sum(M.PROF), distinctcount_blank("SalesOrderID"), distinctcount_blank("CustomerID"),
        F.sum(F.col("OrderQty").cast("bigint")), distinctcount_blank("ProductName"), round_half_up(F.avg(M.REV), 6))
    got = out.select("CategoryName", "TotalRevenue", "TotalProfit", "TotalOrders", "TotalCustomers", "TotalQuantity", "ProductCount", "MeanRevenue")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, plain.collect())))
    assert [f.dataType for f in got.schema] == [f.dataType for f in plain.schema]
    none = M.core_measures(g.where("false"), []).collect()
    assert len(none) == 1 and none[0].TotalOrders is None and none[0].TotalRevenue is None and not M.core_measures(g.where("false"), ["CategoryName"]).collect()
