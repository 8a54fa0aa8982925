"""Oracle SQL for the registered page datasets (one per page)."""

from ledgerframe.plans import measures as M

from .common import BOUNDS, d, dcb, div, growth, r, with_golden
from .measures import M_LIFECYCLE, RFM_C, RFM_S, RFM_SEG, _trend

PAGE_1 = with_golden() + f"""
SELECT CAST(SUM(GrossRevenueUSD) AS DOUBLE) AS TotalRevenue, CAST(SUM(EstimatedNetProfitUSD) AS DOUBLE) AS TotalProfit,
  {dcb('SalesOrderID')} AS TotalOrders,
  {r(div('SUM(EstimatedNetProfitUSD)', 'SUM(GrossRevenueUSD)', '0.0'), 6)} AS ProfitMarginPct
FROM golden
"""

PAGE_2 = with_golden(RFM_C, RFM_S, RFM_SEG, """
pre AS (SELECT CustomerID, CategoryName, SUM(GrossRevenueUSD) AS rev, SUM(EstimatedNetProfitUSD) AS prof
        FROM golden GROUP BY CustomerID, CategoryName)""") + f"""
SELECT seg.CustomerSegment, pre.CategoryName, {d('SUM(rev)')} AS TotalRevenue, {d('SUM(prof)')} AS TotalProfit,
  {r(div('SUM(prof)', 'SUM(rev)', '0.0'), 6)} AS ProfitMarginPct
FROM pre LEFT JOIN seg ON pre.CustomerID IS NOT DISTINCT FROM seg.CustomerID
GROUP BY seg.CustomerSegment, pre.CategoryName
"""

PAGE_3 = with_golden(RFM_C, RFM_S, RFM_SEG) + """
SELECT CustomerSegment, COUNT(*) AS Customers, CAST(SUM(CustomerLTV) AS DOUBLE) AS TotalLTV
FROM seg GROUP BY CustomerSegment
"""

PAGE_4 = with_golden("""
p AS (SELECT ProductName, SUM(GrossRevenueUSD) AS rev FROM golden GROUP BY ProductName)""") + f"""
SELECT ProductName, {d('rev')} AS TotalRevenue,
  {r(div('SUM(rev) OVER (ORDER BY rev DESC NULLS LAST, ProductName ASC NULLS FIRST ROWS UNBOUNDED PRECEDING)', 'SUM(rev) OVER ()', '0.0') + ' * 100', 6)} AS CumulativeSharePct
FROM p
"""

PAGE_5 = with_golden() + """
SELECT TerritoryRegion, OrderYear AS Year, CAST(SUM(GrossRevenueUSD) AS DOUBLE) AS TotalRevenue,
  CAST(SUM(EstimatedNetProfitUSD) AS DOUBLE) AS TotalProfit, COUNT(DISTINCT SalesOrderID) AS TotalOrders
FROM golden WHERE OrderDate IS NOT NULL GROUP BY TerritoryRegion, OrderYear
"""

PAGE_6 = with_golden("""
a AS (SELECT CAST(dayofweek(OrderDate) + 1 AS INTEGER) AS DayOfWeek, strftime(OrderDate, '%A') AS DayName,
        SUM(GrossRevenueUSD) AS rev FROM golden WHERE OrderDate IS NOT NULL GROUP BY 1, 2)""") + f"""
SELECT DayOfWeek, DayName, {d('rev')} AS TotalRevenue,
  {r(div('rev', '(SELECT SUM(GrossRevenueUSD) FROM golden WHERE OrderDate IS NOT NULL)', '0.0'), 6)} AS RevenueShare
FROM a
"""

PAGE_7 = with_golden() + f"""
SELECT CASE WHEN IsOnlineOrder THEN 'Online' ELSE 'Offline' END AS OrderOnline,
  CASE WHEN GrossRevenueUSD < 100 THEN 'Small (<$100)' WHEN GrossRevenueUSD < 500 THEN 'Medium ($100-$500)'
       WHEN GrossRevenueUSD < 2000 THEN 'Large ($500-$2K)' ELSE 'Extra Large (>$2K)' END AS OrderSizeBucket,
  COUNT(DISTINCT SalesOrderID) AS Orders, COUNT(*) AS Lines, CAST(SUM(GrossRevenueUSD) AS DOUBLE) AS TotalRevenue,
  {r('AVG(DaysToShip)', 6)} AS AvgProcessingDays
FROM golden GROUP BY 1, 2
"""

_Z = div("CAST(COALESCE(GrossRevenueUSD, 0) AS DOUBLE) - (SELECT mu FROM sel)", "(SELECT sd FROM sel)", "0.0")
PAGE_8 = with_golden("""
sel AS (SELECT AVG(GrossRevenueUSD) AS mu, STDDEV_POP(GrossRevenueUSD) AS sd FROM golden)""", f"""
z AS (SELECT GrossRevenueUSD, {_Z} AS z FROM golden)""") + """
SELECT CASE WHEN ABS(z) > 3 THEN 'Critical (|Z| > 3)' WHEN ABS(z) > 2 THEN 'Warning (2-3)' ELSE 'Normal (|Z| <= 2)' END AS ZBand,
  COUNT(*) AS Lines, CAST(SUM(GrossRevenueUSD) AS DOUBLE) AS TotalRevenue
FROM z GROUP BY 1
"""


def _forecast_sql():
    last = "(SELECT MAX(OrderDate) FROM golden)"
    pl = f"(year({last}) * 12 + month({last}) - 1)"
    hist = ", ".join(
        f"COALESCE(CAST(SUM(CASE WHEN OrderYear * 12 + OrderMonth - 1 = {pl} - {i} THEN GrossRevenueUSD END) AS DOUBLE), 0.0) AS h{5 - i}"
        for i in range(6))
    ctes = [f"st0 AS (SELECT {hist}, {pl} AS pl FROM golden WHERE OrderDate IS NOT NULL)"]
    names = [f"h{i}" for i in range(6)]
    for k in range(1, 7):
        w = names[-6:]
        ma6 = "(" + " + ".join(w) + ") / 6"
        mom = div(f"{w[-1]} - {w[-2]}", w[-2], "0.0")
        ctes.append(f"st{k} AS (SELECT *, ({ma6}) * (1 + {mom} + 0.0) AS f{k} FROM st{k - 1})")
        names.append(f"f{k}")
    body = "\nUNION ALL\n".join(
        f"SELECT CAST((pl + {k}) // 12 AS INTEGER) AS Year, CAST((pl + {k}) % 12 + 1 AS INTEGER) AS Month, "
        f"{k} AS Step, {r(f'f{k}', 4)} AS ForecastRevenue FROM st6" for k in range(1, 7))
    return with_golden(*ctes) + body


PAGE_9 = _forecast_sql()


def _kpi(key: str) -> str:
    return with_golden() + f"""
SELECT {key}, {d('SUM(GrossRevenueUSD)')} AS TotalRevenue, {d('SUM(EstimatedNetProfitUSD)')} AS TotalProfit,
  {dcb('SalesOrderID')} AS TotalOrders, {_MARGIN} AS ProfitMarginPct FROM golden GROUP BY {key}"""


_MARGIN = r(div('SUM(EstimatedNetProfitUSD)', 'SUM(GrossRevenueUSD)', '0.0'), 6)
_SUMS = f"{d('SUM(GrossRevenueUSD)')} AS TotalRevenue, {d('SUM(EstimatedNetProfitUSD)')} AS TotalProfit"
_DISCOUNT = "CASE " + " ".join(
    f"WHEN COALESCE(UnitPriceDiscount, 0) {'=' if op == 'eq' else '<='} {cut} THEN '{label}'"
    for cut, label, op in M.DAX_DISCOUNT) + f" ELSE '{M.DAX_DISCOUNT_ELSE}' END"
_ROW_Z = ("sel AS (SELECT AVG(GrossRevenueUSD) AS mu, STDDEV_POP(GrossRevenueUSD) AS sd FROM golden)",
          f"z AS (SELECT *, {_Z} AS RevenueZScore FROM golden)")
_SCATTER = (f"SELECT SalesOrderID, CategoryName, OrderDate, {d('GrossRevenueUSD')} AS GrossRevenueUSD, "
            f"{r('z.RevenueZScore', 6)} AS RevenueZScore FROM z")
_LAST_MONTH = "(SELECT MAX(OrderYear * 12 + OrderMonth) FROM golden)"
_AGE = "OrderYear * 12 + OrderMonth - " + _LAST_MONTH

DATASETS = {
    "g1_category": _kpi("CategoryName"),
    "g1_region": _kpi("TerritoryRegion"),
    "g1_heatmap": with_golden() + "SELECT CategoryName, " + ", ".join(
        f'{d(f"SUM(GrossRevenueUSD) FILTER (OrderMonth = {m})")} AS "{m}"' for m in range(1, 13))
    + " FROM golden WHERE OrderDate IS NOT NULL GROUP BY CategoryName",
    "g2_discount": with_golden() + f"SELECT {_DISCOUNT} AS DiscountBucket, COUNT(*) AS Lines, {_SUMS} FROM golden GROUP BY 1",
    "g2_subcategory": with_golden() + f"""
SELECT SubcategoryName, {d('SUM(GrossRevenueUSD)')} AS TotalRevenue, {_MARGIN} AS ProfitMarginPct
FROM golden GROUP BY SubcategoryName""",
    "g3_matrix": with_golden(RFM_C, RFM_S, RFM_SEG) + "SELECT RScore, FScore, COUNT(*) AS Customers FROM seg GROUP BY 1, 2",
    "g3_top": with_golden() + f"""
SELECT CustomerName, {d('SUM(GrossRevenueUSD)')} AS TotalRevenue, {dcb('SalesOrderID')} AS Orders FROM golden
GROUP BY CustomerName ORDER BY SUM(GrossRevenueUSD) DESC NULLS LAST, CustomerName NULLS FIRST LIMIT 20""",
    "g3_repeat": with_golden(f"buyer AS (SELECT CustomerID, {dcb('SalesOrderID')} AS n FROM golden GROUP BY CustomerID)")
    + "SELECT CAST(COUNT(*) FILTER (n > 1) AS DOUBLE) / COUNT(*) AS RepeatCustomerPct FROM buyer",
    "g4_portfolio": with_golden(BOUNDS, f"""
item AS (
  SELECT ProductName, SUM(GrossRevenueUSD) AS rev, SUM(OrderQty) AS qty, {dcb('SalesOrderID')} AS n,
    SUM(GrossRevenueUSD) FILTER (OrderYear < (SELECT year(e) FROM bounds)) AS old
  FROM golden GROUP BY ProductName)""") + f"""
SELECT ProductName, {d('rev')} AS TotalRevenue, {r(div('rev', '(SELECT SUM(rev) FROM item)', '0.0'), 6)} AS ProductContributionPct,
  {r(div('qty', 'n', '0.0'), 6)} AS ProductVelocity, {r(growth('rev', 'old'), 6)} AS YoYGrowthPct FROM item""",
    "g4_stages": f"SELECT ProductLifecycleStage, COUNT(DISTINCT ProductName) AS Products FROM ({M_LIFECYCLE}) GROUP BY 1",
    "g4_color": with_golden() + f"""
SELECT ProductColor, CategoryName, {_MARGIN} AS ProfitMarginPct FROM golden GROUP BY ProductColor, CategoryName""",
    "g4_top": with_golden() + f"""
SELECT ProductName, CategoryName, {_SUMS} FROM golden GROUP BY ProductName, CategoryName
ORDER BY SUM(GrossRevenueUSD) DESC NULLS LAST, ProductName, CategoryName LIMIT 20""",
    "g6_year_month": with_golden() + f"""
SELECT OrderYear AS Year, OrderMonth AS Month, {d('SUM(GrossRevenueUSD)')} AS TotalRevenue
FROM golden WHERE OrderDate IS NOT NULL GROUP BY OrderYear, OrderMonth""",
    "g6_series": with_golden() + f"""
SELECT strftime(OrderDate, '%b %Y') AS MonthYear, OrderYear AS Year, OrderMonth AS Month,
  {d('SUM(GrossRevenueUSD)')} AS TotalRevenue FROM golden WHERE OrderDate IS NOT NULL GROUP BY 1, 2, 3""",
    "g7_daily": with_golden() + f"""
SELECT OrderDate, {dcb('SalesOrderID')} AS Orders FROM golden WHERE OrderDate IS NOT NULL GROUP BY OrderDate""",
    "g7_kpis": with_golden(BOUNDS, f"""
daily AS (SELECT OrderDate, {dcb('SalesOrderID')} AS n FROM golden WHERE OrderDate IS NOT NULL GROUP BY OrderDate)""", f"""
whole AS (SELECT {dcb('SalesOrderID')} AS n, SUM(OrderQty) AS qty, AVG(DaysToShip) AS proc, AVG(UnitPriceDiscount) AS off,
  COUNT(DISTINCT SalesOrderID) FILTER (OrderStatus = '{M.FULFILLED_STATUS}') AS done FROM golden)""") + f"""
SELECT n AS TotalOrders, {r('proc', 6)} AS AvgProcessingDays, {r('(SELECT AVG(n) FROM daily)', 6)} AS AvgOrdersPerDay,
  {r(div('qty', 'n', '0.0'), 6)} AS AvgItemsPerOrder, {r(div('done', 'n', '0.0'), 6)} AS OrderFulfillmentRate,
  {r('n / (SELECT CAST(e - s + 1 AS DOUBLE) FROM bounds)', 6)} AS OrdersPerDay, {r('off', 6)} AS AvgDiscountPct FROM whole""",
    "g8_scatter": with_golden(*_ROW_Z) + _SCATTER,
    "g8_log": with_golden(*_ROW_Z) + _SCATTER + " WHERE ABS(z.RevenueZScore) > 2",
    "g8_kpis": with_golden(*_ROW_Z) + f"""
SELECT {r('AVG(GrossRevenueUSD)', 6)} AS MeanRevenue, {r('STDDEV_POP(GrossRevenueUSD)', 6)} AS RevenueStdDev,
  {r('VAR_POP(GrossRevenueUSD)', 4)} AS RevenueVariance,
  {r('CAST(COUNT(*) FILTER (ABS(RevenueZScore) > 2) AS DOUBLE) / COUNT(*)', 6)} AS OutlierPct FROM z""",
    "g9_volatility": with_golden() + f"""
SELECT {r('STDDEV_POP(EstimatedNetProfitUSD) / AVG(EstimatedNetProfitUSD)', 6)} AS ProfitVolatility FROM golden""",
    "g9_trend": with_golden(f"""
recent AS (
  SELECT CategoryName, SUM(GrossRevenueUSD) FILTER ({_AGE} = 0) AS rev,
    SUM(GrossRevenueUSD) FILTER ({_AGE} BETWEEN -5 AND 0) / 6 AS ma6
  FROM golden WHERE OrderDate IS NOT NULL GROUP BY CategoryName)""") + f"""
SELECT CategoryName, {d('rev')} AS TotalRevenue, {r('ma6', 6)} AS MA6Month, {_trend('rev', 'ma6')} AS TrendDirection FROM recent""",
}
