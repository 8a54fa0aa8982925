"""`evaluate`: one pass over the record, any grain, filter contexts."""

import re
from itertools import product

import pytest
from helpers import golden_df, line
from pyspark.sql import functions as F

from ledgerframe import registry
from ledgerframe.plans import evaluator as EV
from ledgerframe.plans import golden as G
from ledgerframe.plans import measures as M
from ledgerframe.plans.context import ROW, Context, calculate

SF = "/root/testdata/sf0.001"


def _scans(df) -> int:
    """Scans of the record in the plan that ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0].count("FileScan parquet")


@pytest.fixture(scope="module")
def record(spark):
    return G.materialize(G.golden_from_tables(spark, SF))


@pytest.mark.parametrize("name", ["m_eval_quarter", "m_eval_day", "m_eval_retention_year", "m_eval_retention_month"])
def test_one_scan_of_the_record(record, name):
    assert _scans(registry.GOLDEN_QUERIES[name](record)) == 1


def test_one_scan_with_segments(record):
    assert _scans(registry.GOLDEN_QUERIES["m_eval_segment_year"](record)) == 1


def test_no_expand(record):
    df = EV.evaluate(record, ["TotalOrders", "TotalCustomers", "AvgOrdersPerDay", "OrderFulfillmentRate"], ["TerritoryName"])
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def _at(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_whole_record_without_keys(spark):
    rows = [line(1, "2020-01-05", customer_id=1, revenue="100"), line(1, "2020-01-05", customer_id=1, revenue="50"),
            line(2, "2020-01-05", customer_id=None, revenue="30"), line(3, "2020-02-01", customer_id=None, revenue="20")]
    r = EV.evaluate(golden_df(spark, rows), ["TotalRevenue", "TotalOrders", "TotalCustomers", "AvgOrdersPerDay", "ProductCount"], []).first()
    assert (float(r.TotalRevenue), r.TotalOrders, r.TotalCustomers, r.AvgOrdersPerDay, r.ProductCount) == (200.0, 3, 2, 1.5, 1)


def test_blank_orders_count_once(spark):
    rows = [line(1, "2020-01-05"), line(2, "2020-01-06"), line(3, "2020-02-06")]
    rows[1]["SalesOrderID"] = rows[2]["SalesOrderID"] = None
    g = golden_df(spark, rows)
    assert EV.evaluate(g, ["TotalOrders"], []).first().TotalOrders == 2
    months = _at(EV.evaluate(g, ["TotalOrders"], ["Year", "Month"]), "Year", "Month")
    assert {k: r.TotalOrders for k, r in months.items()} == {(2020, 1): 2, (2020, 2): 1}


def test_days_shift_by_their_number_and_meet_at_months_ends(spark):
    g = golden_df(spark, [line(1, "2020-02-28", revenue="1"), line(2, "2020-02-29", revenue="10"), line(3, "2020-01-31", revenue="100")])
    t = {str(k[0]): r for k, r in _at(EV.evaluate(g, ["PMRevenue", "MA3Month"], ["Date"]), "Date").items()}
    pm = {k: float(r.PMRevenue) for k, r in t.items() if r.PMRevenue is not None}
    assert pm == {"2020-03-28": 1.0, "2020-03-29": 10.0, "2020-03-30": 10.0, "2020-03-31": 10.0}
    assert t["2020-04-30"].MA3Month == 37.0  # (30 January, 30 April]
    assert t["2020-05-01"].MA3Month == round(11 / 3, 6)
    assert t["2020-05-28"].MA3Month == round(10 / 3, 6) and "2020-06-30" not in t


def test_quarters_shift_month_by_month(spark):
    g = golden_df(spark, [line(1, "2020-03-10", revenue="1"), line(2, "2020-05-10", revenue="10"), line(3, "2019-06-30", revenue="100")])
    q = _at(EV.evaluate(g, ["TotalRevenue", "PMRevenue", "PYRevenue", "MA3Month", "MA6Month"], ["Year", "Quarter"]), "Year", "Quarter")
    r = q[(2020, 2)]
    assert [float(x) for x in (r.TotalRevenue, r.PMRevenue, r.PYRevenue)] == [10.0, 11.0, 100.0]
    assert (r.MA3Month, r.MA6Month) == (round(10 / 3, 6), round(11 / 6, 6))


@pytest.mark.parametrize("by,want", [
    (["Year"], {(2020,): (2, 0.5, 0.5), (2021,): (1, round(1 / 3, 6), 0.0)}),
    (["Year", "Quarter"], {(2020, 1): (2, 1.0, 0.0), (2020, 2): (1, 0.5, 0.0), (2020, 4): (2, 0.0, 0.5), (2021, 1): (1, 0.5, 0.0)})])
def test_retention_at_any_period(spark, by, want):
    """2020: customers 1 and 2; December of 2020 is seen by January 2021."""
    rows = [line(1, "2020-02-01", customer_id=1), line(2, "2020-03-01", customer_id=2), line(3, "2020-04-01", customer_id=1),
            line(4, "2020-12-05", customer_id=1), line(5, "2020-12-06", customer_id=1), line(6, "2020-12-07", customer_id=None),
            line(7, "2021-01-05", customer_id=None)]
    got = _at(EV.evaluate(golden_df(spark, rows), ["TotalCustomers", "RetentionRate", "RepeatCustomerPct"], by), *by)
    brute = {}
    for key, r in got.items():
        if r.TotalCustomers is not None:
            brute[key] = (r.TotalCustomers, r.RetentionRate, r.RepeatCustomerPct)
    plain = _retention(rows, by)
    assert brute == plain


def _retention(rows, by):
    def month(r):
        return r["OrderDate"].year * 12 + r["OrderDate"].month - 1
    size = 12 if by == ["Year"] else 3
    out = {}
    for p in {month(r) // size for r in rows}:
        now = {r["CustomerID"] for r in rows if month(r) // size == p}
        before = {r["CustomerID"] for r in rows if (month(r) + 1) // size == p}
        orders = {c: len({r["SalesOrderID"] for r in rows if r["CustomerID"] == c and month(r) // size == p}) for c in now}
        key = (p,) if size == 12 else (p // 4, p % 4 + 1)
        out[key] = (len(now), round(len(now & before) / len(before), 6) if before else 0.0,
                    round(sum(n > 1 for n in orders.values()) / len(now), 6))
    return out


def test_segments_are_of_the_whole_record(spark):
    """A selection filters what is summed, not the calculated column."""
    rows = [line(1, "2020-12-31", customer_id=1, revenue="120000"), line(2, "2020-12-30", customer_id=1, revenue="1", category="B")]
    rows += [line(i, "2020-12-30", customer_id=1, revenue="1", category="B") for i in range(3, 13)]
    g = golden_df(spark, rows)
    got = EV.evaluate(g, ["TotalRevenue", "TotalOrders"], ["CustomerSegment"], where="CategoryName = 'B'").collect()
    assert [(r.CustomerSegment, float(r.TotalRevenue), r.TotalOrders) for r in got] == [("Champions", 11.0, 11)]


def test_contexts(spark):
    cells = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0), (None, "y", 8.0)], "k string, p string, v double")
    got = calculate(cells, ["k", "p"], {
        "all_p": ("v", ROW.all_of("p")), "only_p": ("v", ROW.all_except("p", "other")), "sel": ("v", ROW.all_selected()),
        "x": ("v", ROW.replaced("p", "p = 'x'")), "both": ("v", ROW.narrowed("p", "p = 'x'")),
        "nested": ("v", ROW.replaced("p", "p = 'x'").all_of("p")), "far": ("v", ROW.all_selected().replaced("k", "k = 'b'"))})
    names = ["all_p", "only_p", "sel", "x", "both", "nested", "far"]
    rows = {(r.k, r.p): tuple(r[n] for n in names) for r in got.collect()}
    assert rows[("a", "y")] == (3.0, 10.0, 15.0, 1.0, None, 3.0, 4.0)
    assert rows[(None, "y")] == (8.0, 10.0, 15.0, None, None, 8.0, 4.0)
    assert Context().kept(["k", "p"]) == ["k", "p"] and ROW.all_except("p").kept(["k", "p"]) == ["p"]


def test_rank_counts_members_without_rows(spark):
    rows = [line(1, "2019-05-01", territory="A", revenue="10"), line(2, "2020-05-01", territory="A", revenue="5"),
            line(3, "2019-05-01", territory="B", revenue="1"), line(4, "2020-05-01", territory="B", revenue="9"),
            line(5, "2018-05-01", territory="C", revenue="1")]
    got = _at(EV.evaluate(golden_df(spark, rows), ["TerritoryGrowthRank"], ["TerritoryName", "Year"]), "TerritoryName", "Year")
    assert (got[("B", 2020)].TerritoryGrowthRank, got[("A", 2020)].TerritoryGrowthRank) == (1, 3)  # C grows by 0


def test_rejects_what_is_not_defined(record):
    for measures, by in ((["SeasonalIndex"], ["Year"]), (["RetentionRate"], ["Date"]), (["TerritoryGrowthRank"], ["Year"]),
                         (["NoSuch"], []), (["TotalRevenue"], ["Quarter"]), (["TotalRevenue"], ["Date", "Year"])):
        with pytest.raises(ValueError):
            EV.evaluate(record, measures, by)


def test_fixed_year_keeps_the_other_filters(spark):
    g = golden_df(spark, [line(1, "2019-05-01", revenue="10"), line(2, "2020-05-01", revenue="5"), line(3, "2020-06-01", revenue="7")])
    got = _at(EV.evaluate(g, ["Revenue2019"], ["Year", "Month"]), "Year", "Month")
    assert float(got[(2020, 5)].Revenue2019) == 10.0 and got[(2020, 6)].Revenue2019 is None
    assert float(EV.evaluate(g, ["Revenue2020"], ["Year"]).where(F.col("Year") == 2019).first().Revenue2020) == 12.0


def test_segments_and_products_of_a_joined_record(spark):
    """an order's lines lie together after the join, so grouping by order
    moves nothing, and every stage's method is one that the JVM compiles."""
    g, by = G.golden_from_tables(spark, SF), ["Year", "Quarter"]
    wanted = [EV.measure(m) for m in ("TotalRevenue", "RevenueVariance", "RevenueZScore", "ProductCount")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = EV.Base(g, ["CustomerSegment"], EV.grain_of(by), wanted).rolled(None)._jdf.queryExecution()
        text = run.executedPlan().toString()
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", run.explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert not re.search(r"Exchange hashpartitioning\(([^)]*, )?_order#", text)
    assert sizes and max(map(int, sizes)) < 8000


def test_products_of_a_joined_record(spark, record):
    """the product lane that keeps the order gives what the folded one gives."""
    names = ["TotalRevenue", "TotalOrders", "ProductCount", "Top20ProductsRevenue", "RevenueVariance"]
    for by in (["CustomerSegment", "Year", "Quarter"], ["CategoryName"]):
        rows = [sorted(map(str, EV.evaluate(g, names, by).collect())) for g in (G.golden_from_tables(spark, SF), record)]
        assert rows[0] == rows[1] and rows[0]


def test_segment_lookup_follows_the_rules(spark):
    """every combination of scores."""
    scores = spark.createDataFrame(list(product(range(1, 6), repeat=3)), "r int, f int, m int")

    def rule(*x):
        return next((n for n, *bounds in M.DAX_SEGMENTS if all(
            (lo is None or v >= lo) and (hi is None or v <= hi) for v, (lo, hi) in zip(x, bounds, strict=True))), M.DAX_SEGMENT_ELSE)
    out = scores.select("r", "f", "m", M.dax_segment(F.col("r"), F.col("f"), F.col("m")).alias("s")).collect()
    assert len(out) == 125 and all(x.s == rule(x.r, x.f, x.m) for x in out)
