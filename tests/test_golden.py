"""Golden record (2.C): currency ladder branches, joins, row counts."""

import datetime as dt
from decimal import Decimal

from ledgerframe.plans import golden as G
from ledgerframe.plans.cleaning import sales
from ledgerframe.plans.golden import golden, golden_from_tables
from ledgerframe.plans.reports import product
from ledgerframe.sources import tpch

CURRENCIES = [None, "USD", "CAD", "EUR", "GBP", "AUD", "DEM", "FRF", "JPY"]
COUNTRIES = ["US", "CA", "GB", "AU", "FR", "DE", None]


def _inputs(spark):
    sales, profile = [], []
    i = 0
    for cur in CURRENCIES:
        for cc in COUNTRIES:
            i += 1
            sales.append((i, f"SO{i}", i, dt.date(2020, 1, 1), None, "Shipped", True, 1, 2,
                          Decimal("10"), Decimal("0"), Decimal("20"), cur))
            profile.append((i, "B2C (Individual)" if i % 2 else "B2B (Store)", "Store", "T", "R", cc))
    sales.append((1000, "SO1000", 999, dt.date(2020, 1, 1), dt.date(2020, 1, 4), "Shipped", False, 77, 1,
                  Decimal("10"), Decimal("0"), Decimal("10"), "USD"))   # unknown customer and product
    s = spark.createDataFrame(sales, "SalesOrderID long, SalesOrderNumber string, CustomerID long, OrderDate date, "
                                     "ShipDate date, OrderStatus string, IsOnlineOrder boolean, ProductID long, "
                                     "OrderQty int, UnitPrice decimal(19,4), UnitPriceDiscount decimal(19,4), "
                                     "LineTotal decimal(38,6), CurrencyCode string")
    p = spark.createDataFrame([(1, "Bike", "BK", "Bikes", "Road", "Red", "Active", Decimal("4"))],
                              "ProductID long, ProductName string, ProductNumber string, CategoryName string, "
                              "SubcategoryName string, Color string, ProductStatus string, StandardCost decimal(19,4)")
    c = spark.createDataFrame(profile, "CustomerID long, CustomerType string, StoreName string, TerritoryName string, "
                                       "TerritoryRegion string, CountryRegionCode string")
    pe = spark.createDataFrame([(1, "Ann Lee", "ann@x"), (1, "Ann Lee", "ann2@x")],
                               "BusinessEntityID long, FullName string, CleanEmail string")
    return s, p, c, pe


def test_currency_matrix_and_joins(spark):
    s, p, c, pe = _inputs(spark)
    g = G.golden(s, p, c, pe)
    assert g.columns == G.GOLDEN_COLUMNS
    rows = g.collect()
    assert len(rows) == 63 + 1 + 1            # person 1 has two emails: fan-out kept
    by = {}
    for r in rows:
        if r.SalesOrderID <= 63:
            by[(r.RawCurrencyCode, r.CountryRegionCode)] = r
    assert len(by) == 63
    chk = {
        (None, "CA"): ("CAD", "0.74", "NULL - Inferred from Territory"),
        (None, None): ("USD", "1.00", "NULL - Inferred from Territory"),
        (None, "FR"): ("EUR", "1.08", "NULL - Inferred from Territory"),
        ("FRF", "GB"): ("EUR", "1.08", "OLD - Converted to EUR"),     # GBP branch unreachable (Q1)
        ("DEM", "US"): ("EUR", "1.08", "OLD - Converted to EUR"),
        ("GBP", "FR"): ("EUR", "1.27", "WRONG - Corrected EUR"),      # label fixed, rate raw (Q2)
        ("CAD", "US"): ("USD", "0.74", "WRONG - Corrected USD"),
        ("JPY", "DE"): ("JPY", "1.00", "OK"),
        ("AUD", "AU"): ("AUD", "0.66", "OK"),
        ("GBP", None): ("GBP", "1.27", "OK"),
    }
    for k, (cur, rate, flag) in chk.items():
        r = by[k]
        assert (r.CurrencyCode, r.ExchangeRateToUSD, r.CurrencyDataQualityFlag) == (cur, Decimal(rate), flag), k
        assert r.GrossRevenueUSD == Decimal("20") * Decimal(rate)
        assert r.EstimatedNetProfitUSD == (Decimal("20") - Decimal("4") * 2) * Decimal(rate)
    orphan = [r for r in rows if r.SalesOrderID == 1000][0]
    assert orphan.CustomerID is None and orphan.EstimatedNetProfit is None
    assert orphan.CustomerName == "B2C - Customer ID: 999"
    assert orphan.CustomerEmail == "N/A (Update Required)" and orphan.DaysToShip == 3
    b2b = [r for r in rows if r.SalesOrderID == 2][0]
    assert b2b.CustomerName == "B2B - Store ID: 2"
    assert {r.CustomerName for r in rows if r.SalesOrderID == 1} == {"Ann Lee"}


def test_golden_row_count_equals_lines(spark):
    g = G.golden_from_tables(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert g.count() == lines


def test_materialize_roundtrip(spark):
    g = G.golden_from_tables(spark, "/root/testdata/sf0.001")
    m = G.materialize(g)
    assert m.columns == G.GOLDEN_COLUMNS and m.count() == g.count()
    plan = m.where("OrderYear = 1998").select("GrossRevenue")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(OrderYear" in plan


def test_dedupe_person_option(spark):
    s, p, c, pe = _inputs(spark)
    rows = G.golden(s, p, c, pe, dedupe_person=True).collect()
    assert len(rows) == 63 + 1
    assert [r.CustomerEmail for r in rows if r.SalesOrderID == 1] == ["ann2@x"] or \
        [r.CustomerEmail for r in rows if r.SalesOrderID == 1] == ["ann@x"]


def _tables(spark, at):
    """Three orders: of a known customer, of one without a row, and one whose parts have no row."""
    day = dt.datetime(2000, 5, 1)
    made = {
        "region": (["r_regionkey int", "r_name string"], [(0, "EU")]),
        "nation": (["n_nationkey int", "n_name string", "n_regionkey int"], [(1, "CANADA", 0)]),
        "customer": (["c_custkey long", "c_name string", "c_nationkey int"], [(3, "Ann", 1), (4, "Bob", None), (5, "Eve", 1)]),
        "part": (["p_partkey long", "p_name string", "p_brand string", "p_type string", "p_size int", "p_retailprice double"],
                 [(7, "red cog", "B", "T", 2, 10.0), (8, None, None, None, 1, None)]),
        "orders": (["o_orderkey long", "o_custkey long", "o_orderstatus string", "o_totalprice double", "o_orderdate timestamp",
                    "o_orderpriority string"],
                   [(1, 3, "F", 9.0, day, "2-HIGH"), (2, 99, "P", 9.0, day, None), (3, None, "O", 9.0, None, "5-LOW"), (4, 5, "F", 9.0, day, "x"),
                    (5, 4, "F", 9.0, day, "x")]),
        "lineitem": (["l_orderkey long", "l_partkey long", "l_quantity double", "l_extendedprice double", "l_discount double",
                      "l_shipdate timestamp"],
                     [(1, 7, 2.0, 40.0, 0.05, day), (1, 8, 1.0, 5.0, 0.0, None), (2, 7, 1.0, 20.0, 0.0, day), (3, 77, 1.0, 1.0, 0.0, day),
                      (4, None, 1.0, 1.0, 0.0, day), (5, 7, 1.0, 20.0, 0.0, day), (None, 7, 1.0, 1.0, 0.0, day), (6, 7, 1.0, 1.0, 0.0, day)]),
    }
    for name, (columns, rows) in made.items():
        spark.createDataFrame(rows, ", ".join(columns)).coalesce(1).write.parquet(f"{at}/{name}.parquet")


def test_columns_derived_after_the_joins(spark, tmp_path):
    """The fused record equals the three left joins over the views; what was not found is NULL."""
    _tables(spark, tmp_path)
    at = str(tmp_path)
    fused = golden_from_tables(spark, at)
    plain = golden(tpch.sales_performance(spark, at), tpch.product_master(spark, at), tpch.customer_profile(spark, at),
                   tpch.person(spark, at))
    assert sorted(map(str, fused.collect())) == sorted(map(str, plain.collect()))
    rows = {(r.SalesOrderID, r.OrderQty): r for r in fused.collect()}
    assert len(rows) == 6 and rows[2, 1].StoreName is None and rows[1, 2].StoreName == "Ann"
    assert rows[3, 1].ProductStatus is None and rows[3, 1].ProductColor is None and rows[1, 1].ProductColor == "No Color"


def test_partitions_of_the_line_join_follow_the_lines(spark, tmp_path, monkeypatch):
    """A task holds a fixed number of lines: more lines, more partitions, not larger ones."""
    _tables(spark, tmp_path)
    assert tpch.line_tasks(spark, str(tmp_path)) is None  # few lines: as Spark plans it
    usual = golden_from_tables(spark, str(tmp_path)).collect()
    monkeypatch.setattr(tpch, "ROWS_PER_TASK", 1)
    assert tpch.line_tasks(spark, str(tmp_path)) == 8
    g = golden_from_tables(spark, str(tmp_path))
    assert g.rdd.getNumPartitions() == 8
    assert sorted(map(str, g.collect())) == sorted(map(str, usual))


def test_affinity_computes_the_record_once_for_its_pairs(spark, tmp_path):
    """Baskets were measured by joining the record's lines to themselves, so that a task held them twice."""
    _tables(spark, tmp_path)
    g = golden_from_tables(spark, str(tmp_path))
    plan = product.product_affinity(g, top=None)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "l_extendedprice" in x.split("Batched")[0]]
    assert len(scans) == 1


def test_dimensions_meet_their_side_of_the_sales_view(spark, tmp_path):
    """the same rows as joined to whole lines (keys null, repeated or not
    found), but lines are not shuffled with a customer's columns."""
    day = dt.datetime(2000, 5, 1)
    made = {  # read from files: columns of a local table would be computed in the plan
        "header": ("SalesOrderID long, SalesOrderNumber string, CustomerID long, TerritoryID int, CurrencyRateID int, Status int, OrderDate timestamp, "
                   "ShipDate timestamp, OnlineOrderFlag boolean, SubTotal decimal(19,4), TaxAmt decimal(19,4), Freight decimal(19,4), TotalDue decimal(19,4)",
                   [(k, f"SO{k}", c, 1, r, 5, day, None, True, None, None, None, None)
                    for k, c, r in [(1, 3, 3), (1, 3, 3), (2, 99, None), (3, None, 9), (None, 3, 3), (4, 5, 3)]]),
        "detail": ("SalesOrderID long, ProductID long, OrderQty int, UnitPrice decimal(19,4), UnitPriceDiscount decimal(19,4), LineTotal decimal(38,6)",
                   [(k, p, 2, Decimal(4), Decimal(0), Decimal(8)) for k, p in [(1, 7), (1, None), (2, 7), (3, 8), (None, 7), (4, 77), (6, 7)]]),
        "rate": ("CurrencyRateID int, ToCurrencyCode string", [(3, "USD"), (4, "CAD")]),
        "product": ("ProductID long, ProductName string, ProductNumber string, CategoryName string, SubcategoryName string, Color string, "
                    "ProductStatus string, StandardCost decimal(19,4)",
                    [(k, n, f"PN-{k}", "C", "S", "Red", "Active", Decimal(1)) for k, n in [(7, "cog"), (8, None), (8, "cam"), (None, "x")]]),
        "profile": ("CustomerID long, CustomerType string, StoreName string, TerritoryName string, TerritoryRegion string, CountryRegionCode string",
                    [(3, "B2B (Store)", "Ann", "T", "EU", "CA"), (5, "Unknown", "Eve", "T", "EU", "US"), (5, "Unknown", "Eva", "T", "EU", "US")]),
        "person": ("BusinessEntityID long, FullName string, CleanEmail string", [(3, "Ann", "a@x"), (3, "Ann", "b@x"), (None, "N", "n@x")]),
    }
    t = {}
    for name, (columns, rows) in made.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        t[name] = spark.read.parquet(f"{tmp_path}/{name}")
    view = sales.sales_performance({"Sales.SalesOrderHeader": t["header"], "Sales.SalesOrderDetail": t["detail"], "Sales.CurrencyRate": t["rate"]})
    others = t["product"], t["profile"], t["person"]
    whole = golden(view.select("*"), *others)  # notes no sides
    assert whole.count() == 13
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        g = golden(view, *others)
        assert sorted(map(str, g.collect())) == sorted(map(str, whole.collect())) and g.columns == whole.columns
        plan = g._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    trees = []  # what lies below the shuffle on the customer
    for i, node in enumerate(plan):
        if "Exchange hashpartitioning(S_CustomerID" in node:
            depth = node.index("Exchange")
            inside = [len(x) - len(x.lstrip(" :+-*(0123456789)")) > depth for x in plan[i + 1:]]
            trees.append(plan[i + 1:i + 1 + (inside + [False]).index(False)])
    assert trees and not any("LineTotal" in x for tree in trees for x in tree)
