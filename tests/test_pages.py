"""Page datasets add up; measure invariants hold."""

import pytest
from pyspark.sql import functions as F

from ledgerframe.plans import evaluator as EV
from ledgerframe.plans import golden as G
from ledgerframe.plans import measures as M
from ledgerframe.plans import pages as P


@pytest.fixture(scope="module")
def g(spark):
    return G.materialize(G.golden_from_tables(spark, "/root/testdata/sf0.001"))


# Datasets whose rows split the record: their revenue adds up to all of it.
ADDITIVE = {(1, "kpis"), (1, "revenue_by_category"), (1, "revenue_by_region"), (2, "discount_table"),
            (2, "margin_by_subcategory"), (2, "margin_heatmap"), (4, "portfolio"), (4, "pareto"), (5, "region_kpis"),
            (5, "trend"), (6, "year_month"), (6, "day_of_week"), (6, "month_year_series"), (7, "channel_size"),
            (8, "z_bands")}
# Pivots by month or year: all cells together are the whole revenue.
PIVOTS = {(1, "category_month_heatmap"): 1, (5, "territory_year_matrix"): 1, (6, "month_year_heatmap"): 1}


@pytest.mark.parametrize("n", range(1, 10))
def test_page_datasets_hold_the_whole_record(g, n):
    total = float(g.agg(F.sum("GrossRevenueUSD").alias("t")).first().t)
    for name, df in P.PAGES[n](g).items():
        rows = df.collect()
        assert rows, name
        assert len(rows) == len(set(map(str, rows))) or name == "z_scatter", name
        if (n, name) in ADDITIVE:
            assert float(sum(r.TotalRevenue for r in rows)) == pytest.approx(total), name
        if (n, name) in PIVOTS:
            cells = [x for r in rows for x in tuple(r)[PIVOTS[n, name]:] if x is not None]
            assert float(sum(cells)) == pytest.approx(total), name


def test_alert_bands_partition_rows(g):
    a = M.anomaly_measures(g, ["CategoryName"]).collect()
    rows = {r.CategoryName: r.c for r in g.groupBy("CategoryName").agg(F.count(F.lit(1)).alias("c")).collect()}
    for r in a:
        assert r.AlertNormal + r.AlertWarning + r.AlertCritical == rows[r.CategoryName]
        assert r.PositiveOutliers + r.NegativeOutliers == r.CountOfOutliers


def test_contribution_shares_sum_to_one(g):
    s = M.product_measures(g, ["CategoryName"]).groupBy("CategoryName").agg(
        F.sum("ProductContributionPct").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-4 for r in s)   # shares are rounded to 6 decimals


def test_pareto_curve_ends_at_100(g):
    top = P.pareto_curve(g).agg(F.max("CumulativeSharePct").alias("m")).first().m
    assert abs(top - 100) < 1e-6


def test_scenario_series_is_exact(g):
    vals = [float(v) for v in M.scenario_series()]
    assert len(vals) == 21 and vals[0] == -0.5 and vals[10] == 0.0 and vals[-1] == 0.5


def test_page_slicer(g):
    full = P.page_1(g)["kpis"].first().TotalOrders
    part = P.page_1(g, where="TerritoryRegion = 'AMERICA'")["kpis"].first().TotalOrders
    assert 0 < part < full


def test_write_pages(spark, g, tmp_path):
    out = P.write_pages(g, str(tmp_path), pages=[1, 7])
    assert "page_1/kpis" in out and "page_7/channel_size" in out
    assert spark.read.parquet(out["page_1/kpis"]).count() == 1


def test_evaluate_rejects_unknown_grains(g):
    with pytest.raises(ValueError, match="RetentionRate"):
        EV.evaluate(g, ["TotalRevenue", "RetentionRate"], ["CategoryName"])
    with pytest.raises(ValueError, match="not a grain"):
        EV.evaluate(g, ["TotalRevenue"], ["Month"])


def test_noted_statistics_are_those_of_the_record(g):
    from ledgerframe.operators.stats import known
    from ledgerframe.plans.calendar import calendar_bounds
    plain = g.where("true")
    assert known(plain, "latest") is None
    assert tuple(calendar_bounds(g).first()) == tuple(calendar_bounds(plain).first())
    assert known(g, "latest") == plain.agg(F.max("OrderDate").alias("m")).first().m
