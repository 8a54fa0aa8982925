"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver's check runs the same pairs at sf0.01)."""

import pytest

import __spark_entry__ as E
from ledgerframe import registry
from ledgerframe.sources.tpch import TABLES
from oracle.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF, TABLES)


def test_every_query_has_an_oracle():
    """The training-data operators, where present, have SQL only if SQL can
    express them; their own tests run it."""
    assert set(registry.QUERIES) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF), con, SQL[name], exact=True)
    assert ok, f"{name}: {msg}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["OrderYear", "OrderMonth", "CurrencyCode", "MonthlyRevenue", "MonthlyProfit",
                          "MoM_Growth_Pct", "YoY_Growth_Pct", "ProfitMargin_Pct", "ThreeMonth_MA",
                          "Deviation_From_Trend_Pct"]


def test_rfm_over_several_ranges_matches_oracle(spark, con, monkeypatch):
    import ledgerframe.operators.ranking as R
    monkeypatch.setattr(R.global_ntiles, "__defaults__", (3,))
    ok, msg = compare(QUERIES["d2_1"](spark, SF), con, SQL["d2_1"], exact=True)
    assert ok, msg
