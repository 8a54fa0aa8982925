"""Oracle SQL for the date table and the measure families."""

from .common import BOUNDS, SPINE, d, dcb, div, growth, r, with_golden

CAL = with_golden(BOUNDS, """
days AS (SELECT CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS Date FROM bounds)
""") + """
SELECT Date, CAST(year(Date) AS INTEGER) AS Year, strftime(Date, '%Y-%m') AS YearMonth,
  'Q' || CAST(quarter(Date) AS VARCHAR) || ' ' || CAST(year(Date) AS VARCHAR) AS YearQuarter,
  CAST(quarter(Date) AS INTEGER) AS Quarter, 'Q' || CAST(quarter(Date) AS VARCHAR) AS QuarterName,
  CAST(month(Date) AS INTEGER) AS Month, strftime(Date, '%B') AS MonthName, strftime(Date, '%b') AS MonthShort,
  strftime(Date, '%b %Y') AS MonthYear,
  CAST(floor((dayofyear(Date) + dayofweek(make_date(year(Date), 1, 1)) + 1 - 2) / 7) + 1 AS INTEGER) AS WeekOfYear,
  CAST(dayofweek(Date) + 1 AS INTEGER) AS DayOfWeek, strftime(Date, '%A') AS DayName, strftime(Date, '%a') AS DayShort,
  dayofweek(Date) IN (0, 6) AS IsWeekend,
  CAST(CASE WHEN month(Date) >= 7 THEN year(Date) + 1 ELSE year(Date) END AS INTEGER) AS FiscalYear,
  CAST(day(Date) AS INTEGER) AS DayOfMonth, Date = last_day(Date) AS IsLastDayOfMonth
FROM days
"""

M_CORE = with_golden() + f"""
SELECT CategoryName, TerritoryRegion,
  CAST(SUM(GrossRevenueUSD) AS DOUBLE) AS TotalRevenue, CAST(SUM(EstimatedNetProfitUSD) AS DOUBLE) AS TotalProfit,
  {dcb('SalesOrderID')} AS TotalOrders, {dcb('CustomerID')} AS TotalCustomers,
  CAST(SUM(OrderQty) AS BIGINT) AS TotalQuantity, {dcb('ProductName')} AS ProductCount,
  {r(div('SUM(EstimatedNetProfitUSD)', 'SUM(GrossRevenueUSD)', '0.0'), 6)} AS ProfitMarginPct,
  {r(div('SUM(GrossRevenueUSD)', dcb('SalesOrderID'), '0.0'), 6)} AS AvgOrderValue,
  {r(div('SUM(GrossRevenueUSD)', 'COUNT(*)', '0.0'), 6)} AS AvgRevenuePerTransaction,
  {r('AVG(GrossRevenueUSD)', 6)} AS MeanRevenue
FROM golden GROUP BY CategoryName, TerritoryRegion
"""

_MON = """mon AS (
  SELECT OrderYear AS Year, OrderMonth AS Month, SUM(GrossRevenueUSD) AS TotalRevenue,
    SUM(EstimatedNetProfitUSD) AS TotalProfit, AVG(GrossRevenueUSD) AS MeanRev,
    STDDEV_POP(EstimatedNetProfitUSD) AS ProfSd, AVG(EstimatedNetProfitUSD) AS ProfMean
  FROM golden WHERE OrderDate IS NOT NULL GROUP BY OrderYear, OrderMonth
)"""
_BASE = """base AS (SELECT s.Year, s.Month, s.p, m.TotalRevenue, m.TotalProfit, m.MeanRev, m.ProfSd, m.ProfMean
  FROM spine s LEFT JOIN mon m ON s.Year = m.Year AND s.Month = m.Month)"""


def _health(x):
    return (f"CASE WHEN {x} > 5 THEN '📈 Excellent Growth' WHEN {x} > 0 THEN '✅ Positive Growth' "
            f"WHEN {x} > -5 THEN '⚠️ Warning - Slight Decline' ELSE '🔴 Critical - Significant Decline' END")


_YEARS = (2022, 2023, 2024, 2025)
def _time(years) -> str:
    return with_golden(BOUNDS, SPINE, _MON, _BASE, """
t AS (SELECT *, LAG(TotalRevenue, 1) OVER (ORDER BY p) AS PMRevenue, LAG(TotalRevenue, 12) OVER (ORDER BY p) AS PYRevenue,
        LAG(TotalProfit, 1) OVER (ORDER BY p) AS PMProfit FROM base)""",
  "bm AS (SELECT OrderMonth AS Month, " + ", ".join(
      f"SUM(CASE WHEN OrderYear = {k} THEN GrossRevenueUSD END) AS Revenue{k}" for k in years)
  + " FROM golden WHERE OrderDate IS NOT NULL GROUP BY OrderMonth)") + f"""
SELECT t.Year, t.Month, {d('TotalRevenue')} AS TotalRevenue, {d('TotalProfit')} AS TotalProfit,
  {d('PMRevenue')} AS PMRevenue, {d('PYRevenue')} AS PYRevenue, {d('PMProfit')} AS PMProfit,
  {r(growth('TotalRevenue', 'PMRevenue'), 6)} AS MoMGrowthPct,
  {r(growth('TotalRevenue', 'PYRevenue'), 6)} AS YoYGrowthPct,
  {r(growth('TotalProfit', 'PMProfit'), 6)} AS MoMProfitGrowthPct,
  {_health(growth('TotalRevenue', 'PMRevenue'))} AS HealthStatus,
  """ + ", ".join(f"{d(f'Revenue{k}')} AS Revenue{k}" for k in years) + """
FROM t LEFT JOIN bm ON t.Month = bm.Month
WHERE TotalRevenue IS NOT NULL OR PMRevenue IS NOT NULL OR PYRevenue IS NOT NULL
"""


M_TIME, M_TIME_YEARS = _time(_YEARS), _time((1996, 1997, 1998, 1999))

M_MA = with_golden(BOUNDS, SPINE, _MON, _BASE, """
t AS (SELECT *, SUM(TotalRevenue) OVER (ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3 AS ma3,
        SUM(TotalRevenue) OVER (ORDER BY p ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 6 AS ma6 FROM base)""") + f"""
SELECT Year, Month, {d('TotalRevenue')} AS TotalRevenue, {r('ma3', 6)} AS MA3Month, {r('ma6', 6)} AS MA6Month
FROM t WHERE ma3 IS NOT NULL OR ma6 IS NOT NULL
"""

M_CUSTOMER = with_golden(BOUNDS, SPINE, f"""
cm AS (SELECT OrderYear * 12 + OrderMonth - 1 AS p, CustomerID, {dcb('SalesOrderID')} AS n_orders
       FROM golden WHERE OrderDate IS NOT NULL GROUP BY OrderYear, OrderMonth, CustomerID)""", """
cur AS (SELECT p, COUNT(*) AS TotalCustomers, SUM(CASE WHEN n_orders > 1 THEN 1 ELSE 0 END) AS rep FROM cm GROUP BY p)""", """
ret AS (SELECT a.p, COUNT(*) AS retained FROM cm a JOIN cm b ON a.p = b.p + 1 AND a.CustomerID IS NOT DISTINCT FROM b.CustomerID GROUP BY a.p)""", """
lastd AS (SELECT OrderYear * 12 + OrderMonth - 1 AS p, MAX(OrderDate) AS last FROM golden WHERE OrderDate IS NOT NULL GROUP BY 1)""") + f"""
SELECT s.Year, s.Month, c.TotalCustomers,
  {r(div('COALESCE(ret.retained, 0)', 'pc.TotalCustomers', '0.0'), 6)} AS RetentionRate,
  {r(div('c.rep', 'c.TotalCustomers', '0.0'), 6)} AS RepeatCustomerPct,
  CAST(date_diff('day', l.last, (SELECT MAX(OrderDate) FROM golden)) AS INTEGER) AS DaysSinceLastOrder
FROM spine s LEFT JOIN cur c ON c.p = s.p LEFT JOIN cur pc ON pc.p + 1 = s.p LEFT JOIN ret ON ret.p = s.p
  LEFT JOIN lastd l ON l.p = s.p
WHERE c.TotalCustomers IS NOT NULL OR pc.TotalCustomers IS NOT NULL
"""

RFM_C = f"""
c AS (SELECT CustomerID, CAST(date_diff('day', MAX(OrderDate), (SELECT MAX(OrderDate) FROM golden)) AS INTEGER) AS days,
        {dcb('SalesOrderID')} AS n_orders, SUM(GrossRevenueUSD) AS CustomerLTV
      FROM golden GROUP BY CustomerID)"""
RFM_S = """
s AS (SELECT CustomerID, days, CustomerLTV,
  CASE WHEN COALESCE(days, 0) <= 30 THEN 5 WHEN COALESCE(days, 0) <= 90 THEN 4 WHEN COALESCE(days, 0) <= 180 THEN 3
       WHEN COALESCE(days, 0) <= 365 THEN 2 ELSE 1 END AS RScore,
  CASE WHEN COALESCE(n_orders, 0) >= 20 THEN 5 WHEN COALESCE(n_orders, 0) >= 10 THEN 4 WHEN COALESCE(n_orders, 0) >= 5 THEN 3
       WHEN COALESCE(n_orders, 0) >= 2 THEN 2 ELSE 1 END AS FScore,
  CASE WHEN COALESCE(CustomerLTV, 0) >= 100000 THEN 5 WHEN COALESCE(CustomerLTV, 0) >= 50000 THEN 4
       WHEN COALESCE(CustomerLTV, 0) >= 25000 THEN 3 WHEN COALESCE(CustomerLTV, 0) >= 10000 THEN 2 ELSE 1 END AS MScore
  FROM c)"""
RFM_SEG = """
seg AS (SELECT *,
  CASE WHEN RScore >= 4 AND FScore >= 4 AND MScore >= 4 THEN 'Champions'
       WHEN RScore >= 3 AND FScore >= 3 AND MScore >= 4 THEN 'Loyal Customers'
       WHEN RScore >= 4 AND FScore <= 2 AND MScore >= 3 THEN 'Big Spenders'
       WHEN RScore <= 2 AND FScore >= 3 AND MScore >= 3 THEN 'At Risk'
       WHEN RScore <= 2 AND FScore >= 4 THEN 'Can''t Lose Them'
       WHEN RScore <= 2 THEN 'Lost'
       ELSE 'Regular' END AS CustomerSegment
  FROM s)"""

M_RFM = with_golden(RFM_C, RFM_S, RFM_SEG) + """
SELECT CustomerID, RScore, FScore, MScore, CAST(CustomerLTV AS DOUBLE) AS CustomerLTV, days AS DaysSinceLastOrder,
  CustomerSegment
FROM seg
"""

M_PRODUCT = with_golden(f"""
p AS (SELECT CategoryName, ProductName, SUM(GrossRevenueUSD) AS TotalRevenue, SUM(OrderQty) AS qty,
        {dcb('SalesOrderID')} AS n_orders FROM golden GROUP BY CategoryName, ProductName)""", """
a AS (SELECT CategoryName, SUM(GrossRevenueUSD) AS allrev FROM golden GROUP BY CategoryName)""") + f"""
SELECT p.CategoryName, ProductName, {d('TotalRevenue')} AS TotalRevenue,
  {r(div('TotalRevenue', 'allrev', '0.0'), 6)} AS ProductContributionPct,
  {r(div('qty', 'n_orders', '0.0'), 6)} AS ProductVelocity
FROM p LEFT JOIN a ON p.CategoryName IS NOT DISTINCT FROM a.CategoryName
"""

M_PARETO = with_golden("""
p AS (SELECT CategoryName, ProductName, SUM(GrossRevenueUSD) AS rev FROM golden GROUP BY CategoryName, ProductName)""", """
rk AS (SELECT *, RANK() OVER (PARTITION BY CategoryName ORDER BY rev DESC NULLS LAST) AS rnk,
         CEIL(COUNT(*) OVER (PARTITION BY CategoryName) * 0.2) AS top_n FROM p)""") + f"""
SELECT CategoryName, COUNT(*) AS ProductCount, {d('SUM(rev)')} AS TotalRevenue,
  {d('SUM(CASE WHEN rnk <= top_n THEN rev END)')} AS Top20ProductsRevenue,
  {r(div('SUM(CASE WHEN rnk <= top_n THEN rev END)', 'SUM(rev)', '0.0') + ' * 100', 6)} AS ParetoRatio
FROM rk GROUP BY CategoryName
"""

M_LIFECYCLE = with_golden(BOUNDS, """
ps AS (SELECT ProductName, MIN(OrderDate) AS f, MAX(OrderDate) AS l, SUM(GrossRevenueUSD) AS tr,
         SUM(CASE WHEN OrderYear < (SELECT year(e) FROM bounds) THEN GrossRevenueUSD END) AS py
       FROM golden GROUP BY ProductName)""", """
rw AS (SELECT ProductName, ProductStatus, COUNT(*) AS Lines FROM golden GROUP BY ProductName, ProductStatus)""",
f"""j AS (SELECT rw.*, date_diff('day', ps.f, (SELECT MAX(OrderDate) FROM golden)) AS dsf,
        date_diff('day', ps.l, (SELECT MAX(OrderDate) FROM golden)) AS dsl, {growth('ps.tr', 'ps.py')} AS gr
      FROM rw LEFT JOIN ps ON rw.ProductName IS NOT DISTINCT FROM ps.ProductName)""") + """
SELECT ProductName, ProductStatus,
  CASE WHEN ProductStatus = 'Discontinued' AND dsl > 180 THEN 'Obsolete'
       WHEN ProductStatus = 'Discontinued' THEN 'Phasing Out'
       WHEN dsf < 180 THEN 'New/Launch'
       WHEN gr > 0.20 THEN 'Growth' WHEN gr > 0.05 THEN 'Mature/Stable' WHEN gr > 0 THEN 'Declining'
       ELSE 'Stagnant/No Growth' END AS ProductLifecycleStage,
  Lines
FROM j
"""

M_OPS = with_golden(BOUNDS, f"""
a AS (SELECT TerritoryName, AVG(DaysToShip) AS proc, {dcb('SalesOrderID')} AS TotalOrders, SUM(OrderQty) AS qty,
        COUNT(DISTINCT CASE WHEN OrderStatus = 'Shipped' THEN SalesOrderID END) AS shipped,
        AVG(UnitPriceDiscount) AS disc
      FROM golden GROUP BY TerritoryName)""", f"""
dd AS (SELECT TerritoryName, AVG(n) AS per_day FROM (
        SELECT TerritoryName, OrderDate, {dcb('SalesOrderID')} AS n FROM golden WHERE OrderDate IS NOT NULL
        GROUP BY TerritoryName, OrderDate) GROUP BY TerritoryName)""") + f"""
SELECT a.TerritoryName, TotalOrders,
  {r('proc', 6)} AS AvgProcessingDays, {r('per_day', 6)} AS AvgOrdersPerDay,
  {r(div('qty', 'TotalOrders', '0.0'), 6)} AS AvgItemsPerOrder,
  {r(div('shipped', 'TotalOrders', '0.0'), 6)} AS OrderFulfillmentRate,
  {r(div('TotalOrders', '(SELECT date_diff(' + "'day'" + ', s, e) + 1 FROM bounds)', '0.0'), 6)} AS OrdersPerDay,
  {r('disc', 6)} AS AvgDiscountPct
FROM a LEFT JOIN dd ON a.TerritoryName IS NOT DISTINCT FROM dd.TerritoryName
"""

M_BUCKETS = with_golden() + """
SELECT CASE WHEN IsOnlineOrder THEN 'Online' ELSE 'Offline' END AS OrderOnline,
  CASE WHEN GrossRevenueUSD < 100 THEN 'Small (<$100)' WHEN GrossRevenueUSD < 500 THEN 'Medium ($100-$500)'
       WHEN GrossRevenueUSD < 2000 THEN 'Large ($500-$2K)' ELSE 'Extra Large (>$2K)' END AS OrderSizeBucket,
  CASE WHEN COALESCE(UnitPriceDiscount, 0) = 0 THEN 'No Discount' WHEN COALESCE(UnitPriceDiscount, 0) <= 0.05 THEN 'Small (0-5%)'
       WHEN COALESCE(UnitPriceDiscount, 0) <= 0.15 THEN 'Medium (5-15%)' WHEN COALESCE(UnitPriceDiscount, 0) <= 0.30 THEN 'Large (15-30%)'
       ELSE 'Very Large (>30%)' END AS DiscountBucket,
  COUNT(*) AS Lines, CAST(SUM(GrossRevenueUSD) AS DOUBLE) AS TotalRevenue
FROM golden GROUP BY 1, 2, 3
"""

_Z = div("CAST(COALESCE(GrossRevenueUSD, 0) AS DOUBLE) - (SELECT mu FROM sel)", "(SELECT sd FROM sel)", "0.0")
M_ANOMALY = with_golden("""
sel AS (SELECT AVG(GrossRevenueUSD) AS mu, STDDEV_POP(GrossRevenueUSD) AS sd FROM golden)""", f"""
z AS (SELECT CategoryName, GrossRevenueUSD, {_Z} AS z FROM golden)""") + f"""
SELECT CategoryName, {r('(SELECT sd FROM sel)', 6)} AS RevenueStdDev, {r('VAR_POP(GrossRevenueUSD)', 4)} AS RevenueVariance,
  {r(div('CAST(COALESCE(AVG(GrossRevenueUSD), 0) AS DOUBLE) - (SELECT mu FROM sel)', '(SELECT sd FROM sel)', '0.0'), 6)} AS RevenueZScore,
  CAST(SUM(CASE WHEN ABS(z) > 2 THEN 1 ELSE 0 END) AS BIGINT) AS CountOfOutliers,
  {r(div('SUM(CASE WHEN ABS(z) > 2 THEN 1 ELSE 0 END)', 'COUNT(*)', '0.0'), 6)} AS OutlierPctOfTotal,
  CAST(SUM(CASE WHEN z > 2 THEN 1 ELSE 0 END) AS BIGINT) AS PositiveOutliers,
  CAST(SUM(CASE WHEN z < -2 THEN 1 ELSE 0 END) AS BIGINT) AS NegativeOutliers,
  CAST(SUM(CASE WHEN ABS(z) > 3 THEN 1 ELSE 0 END) AS BIGINT) AS AlertCritical,
  CAST(SUM(CASE WHEN ABS(z) > 2 AND ABS(z) <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS AlertWarning,
  CAST(SUM(CASE WHEN ABS(z) <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS AlertNormal
FROM z GROUP BY CategoryName
"""


def _trend(cur, ma):
    c, m = f"COALESCE({cur}, 0)", f"COALESCE({ma}, 0)"
    return (f"CASE WHEN {c} > {m} * 1.10 THEN 'Strong Growth' WHEN {c} > {m} * 1.05 THEN 'Moderate Growth' "
            f"WHEN {c} > {m} * 0.95 THEN 'Stable' WHEN {c} > {m} * 0.90 THEN 'Moderate Decline' "
            "ELSE 'Strong Decline' END")


_VOL = "(SELECT STDDEV_POP(GrossRevenueUSD) FROM golden) / CAST(MeanRev AS DOUBLE)"
M_FORECAST = with_golden(BOUNDS, SPINE, _MON, _BASE, """
t AS (SELECT *, LAG(TotalRevenue, 1) OVER (ORDER BY p) AS pm,
        SUM(TotalRevenue) OVER (ORDER BY p ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 6 AS ma6 FROM base)""") + f"""
SELECT Year, Month, {d('TotalRevenue')} AS TotalRevenue, {r('ma6', 6)} AS MA6Month,
  {r(growth('TotalRevenue', 'pm'), 6)} AS MoMGrowthPct,
  {r(f"CAST(ma6 AS DOUBLE) * (1 + {growth('TotalRevenue', 'pm')} + 0.0)", 4)} AS ForecastNextMonth,
  {r('ProfSd / NULLIF(CAST(ProfMean AS DOUBLE), 0)', 6)} AS ProfitVolatility,
  CASE WHEN {_VOL} < 0.1 THEN '🟢 High Confidence' WHEN {_VOL} < 0.3 THEN '🟡 Medium Confidence'
       ELSE '🔴 Low Confidence' END AS ForecastConfidence,
  {_trend('TotalRevenue', 'ma6')} AS TrendDirection
FROM t WHERE TotalRevenue IS NOT NULL OR ma6 IS NOT NULL
"""

_LAST = "(SELECT MAX(OrderDate) FROM golden)"
M_SCENARIO = with_golden(BOUNDS, f"""
a AS (SELECT SUM(GrossRevenueUSD) AS tr,
        SUM(CASE WHEN OrderDate <= last_day((SELECT e FROM bounds) - INTERVAL 1 MONTH) THEN GrossRevenueUSD END) AS pm,
        SUM(CASE WHEN OrderDate > (SELECT e FROM bounds) - INTERVAL 6 MONTH THEN GrossRevenueUSD END) AS ma6sum,
        SUM(CASE WHEN OrderDate >= date_trunc('month', {_LAST}) AND OrderDate <= {_LAST} THEN GrossRevenueUSD END) AS lm
      FROM golden)""", """
sc AS (SELECT CAST(-0.50 + 0.05 * i AS DECIMAL(4,2)) AS sv FROM range(0, 21) t(i))""") + f"""
SELECT CAST(sv AS DOUBLE) AS ScenarioValue,
  CASE WHEN sv > 0.20 THEN '🚀 Aggressive Growth' WHEN sv > 0.05 THEN '📈 Optimistic' WHEN sv > -0.05 THEN '📊 Base Case'
       WHEN sv > -0.20 THEN '⚠️ Conservative' ELSE '🔴 Pessimistic' END AS ScenarioLabel,
  {r(growth('tr', 'pm'), 6)} AS MoMGrowthPct,
  {r(f"CAST(ma6sum / 6 AS DOUBLE) * (1 + {growth('tr', 'pm')} + CAST(sv AS DOUBLE))", 4)} AS ForecastNextMonth,
  {r(div('lm', f"date_diff('day', date_trunc('month', {_LAST}), {_LAST}) + 1") + f" * day(last_day({_LAST})) * (1 + {growth('tr', 'pm')} + CAST(sv AS DOUBLE))", 0)} AS RevenueProjection
FROM a, sc
"""

M_SEASON = with_golden("""
m AS (SELECT OrderYear AS Year, OrderMonth AS Month, strftime(OrderDate, '%B') AS MonthName, SUM(GrossRevenueUSD) AS tr
      FROM golden WHERE OrderDate IS NOT NULL GROUP BY 1, 2, 3)""") + f"""
SELECT Year, Month, MonthName, {d('tr')} AS TotalRevenue,
  {r(div('tr', 'AVG(tr) OVER (PARTITION BY Year)'), 6)} AS SeasonalIndex
FROM m
"""

M_WEEKPART = with_golden() + """
SELECT OrderYear AS Year,
  CAST(SUM(CASE WHEN dayofweek(OrderDate) NOT IN (0, 6) THEN GrossRevenueUSD END) AS DOUBLE) AS WeekdayRevenue,
  CAST(SUM(CASE WHEN dayofweek(OrderDate) IN (0, 6) THEN GrossRevenueUSD END) AS DOUBLE) AS WeekendRevenue
FROM golden WHERE OrderDate IS NOT NULL GROUP BY OrderYear
"""

M_TERRITORY = with_golden(BOUNDS, """
sp AS (SELECT TerritoryName, CAST(unnest(generate_series(year((SELECT s FROM bounds)), year((SELECT e FROM bounds)))) AS INTEGER) AS Year
       FROM (SELECT DISTINCT TerritoryName FROM golden WHERE OrderDate IS NOT NULL))""", """
ty AS (SELECT OrderYear AS Year, TerritoryName, SUM(GrossRevenueUSD) AS tr FROM golden WHERE OrderDate IS NOT NULL GROUP BY 1, 2)""", """
t AS (SELECT sp.Year, sp.TerritoryName, ty.tr FROM sp LEFT JOIN ty ON sp.Year = ty.Year AND sp.TerritoryName IS NOT DISTINCT FROM ty.TerritoryName)""", f"""
t2 AS (SELECT a.*, b.tr AS py, {growth('a.tr', 'b.tr')} AS yoy FROM t a LEFT JOIN t b ON a.Year = b.Year + 1 AND a.TerritoryName IS NOT DISTINCT FROM b.TerritoryName)""") + f"""
SELECT Year, TerritoryName, {d('tr')} AS TotalRevenue, {d('py')} AS PYRevenue, {r('yoy', 6)} AS YoYGrowthPct,
  CAST(DENSE_RANK() OVER (PARTITION BY Year ORDER BY yoy DESC) AS INTEGER) AS TerritoryGrowthRank
FROM t2
QUALIFY tr IS NOT NULL OR py IS NOT NULL
"""

CLEAN_PRODUCT = f"""
SELECT p_partkey AS ProductID, p_name AS ProductName, 'PN-' || CAST(p_partkey AS VARCHAR) AS ProductNumber,
  p_type AS CategoryName, p_brand AS SubcategoryName, CAST(NULL AS VARCHAR) AS ModelName,
  COALESCE(split_part(p_name, ' ', 1), 'No Color') AS Color, CAST(p_size AS VARCHAR) AS Size,
  CAST(CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) // CAST(p_size AS BIGINT) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(19,4)) AS DOUBLE) AS StandardCost,
  CAST(CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(19,4)) AS DOUBLE) AS ListPrice,
  CAST(CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(19,4))
     - CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) // CAST(p_size AS BIGINT) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(19,4)) AS DOUBLE) AS ProfitMargin,
  DATE '1990-01-01' AS SellStartDate,
  CASE p_partkey % 4 WHEN 0 THEN DATE '1999-01-01' WHEN 1 THEN DATE '2090-01-01' ELSE DATE '9999-12-31' END AS SellEndDate,
  CASE WHEN p_partkey % 4 IN (2, 3) THEN 'Active' WHEN p_partkey % 4 = 0 THEN 'Discontinued' ELSE 'Active' END AS ProductStatus
FROM part
"""

CLEAN_CUSTOMER = """
SELECT c.c_custkey AS CustomerID, 'AW' || lpad(CAST(c.c_custkey AS VARCHAR), 8, '0') AS AccountNumber,
  CASE c.c_custkey % 3 WHEN 0 THEN 'B2B (Store)' WHEN 1 THEN 'B2C (Individual)' ELSE 'Unknown' END AS CustomerType,
  CASE WHEN c.c_custkey % 3 = 0 THEN c.c_name ELSE 'Individual Customer' END AS StoreName,
  n.n_name AS TerritoryName, r.r_name AS TerritoryRegion,
  CASE n.n_nationkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'GB' WHEN 3 THEN 'AU' WHEN 4 THEN 'FR' WHEN 5 THEN 'DE' END AS CountryRegionCode
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
"""

M_LTV = with_golden(RFM_C, RFM_S, RFM_SEG, """
pre AS (SELECT CustomerID, CategoryName, SUM(GrossRevenueUSD) AS rev FROM golden GROUP BY CustomerID, CategoryName)""", """
vis AS (SELECT seg.CustomerSegment, pre.CategoryName, SUM(rev) AS tr
        FROM pre LEFT JOIN seg ON pre.CustomerID IS NOT DISTINCT FROM seg.CustomerID GROUP BY 1, 2)""") + """
SELECT CustomerSegment, CategoryName, CAST(tr AS DOUBLE) AS TotalRevenue,
  CAST(SUM(tr) OVER (PARTITION BY CustomerSegment) AS DOUBLE) AS CustomerLTV
FROM vis
"""


def _time_by(key: str) -> str:
    """Time intelligence per ``key`` on a dense (key × month) spine."""
    years = ", ".join(f"SUM(CASE WHEN OrderYear = {k} THEN GrossRevenueUSD END) AS Revenue{k}" for k in _YEARS)
    return with_golden(BOUNDS, f"""
keys AS (SELECT DISTINCT {key} FROM golden WHERE OrderDate IS NOT NULL)""", f"""
kspine AS (
  SELECT k.{key}, CAST(year(m) AS INTEGER) AS Year, CAST(month(m) AS INTEGER) AS Month,
         CAST(year(m) * 12 + month(m) - 1 AS INTEGER) AS p
  FROM keys k, (SELECT unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM bounds))""", f"""
kmon AS (SELECT {key}, OrderYear AS Year, OrderMonth AS Month, SUM(GrossRevenueUSD) AS TotalRevenue,
           SUM(EstimatedNetProfitUSD) AS TotalProfit
         FROM golden WHERE OrderDate IS NOT NULL GROUP BY 1, 2, 3)""", f"""
kbase AS (SELECT s.*, m.TotalRevenue, m.TotalProfit FROM kspine s LEFT JOIN kmon m
          ON s.{key} IS NOT DISTINCT FROM m.{key} AND s.Year = m.Year AND s.Month = m.Month)""", f"""
t AS (SELECT *, LAG(TotalRevenue, 1) OVER w AS PMRevenue, LAG(TotalRevenue, 12) OVER w AS PYRevenue,
        LAG(TotalProfit, 1) OVER w AS PMProfit FROM kbase WINDOW w AS (PARTITION BY {key} ORDER BY p))""",
        f"bm AS (SELECT {key}, OrderMonth AS Month, {years} FROM golden WHERE OrderDate IS NOT NULL GROUP BY 1, 2)") + f"""
SELECT t.{key}, t.Year, t.Month, {d('TotalRevenue')} AS TotalRevenue, {d('TotalProfit')} AS TotalProfit,
  {d('PMRevenue')} AS PMRevenue, {d('PYRevenue')} AS PYRevenue, {d('PMProfit')} AS PMProfit,
  {r(growth('TotalRevenue', 'PMRevenue'), 6)} AS MoMGrowthPct,
  {r(growth('TotalRevenue', 'PYRevenue'), 6)} AS YoYGrowthPct,
  {r(growth('TotalProfit', 'PMProfit'), 6)} AS MoMProfitGrowthPct,
  {_health(growth('TotalRevenue', 'PMRevenue'))} AS HealthStatus,
  """ + ", ".join(f"{d(f'Revenue{k}')} AS Revenue{k}" for k in _YEARS) + f"""
FROM t LEFT JOIN bm ON t.{key} IS NOT DISTINCT FROM bm.{key} AND t.Month = bm.Month
WHERE TotalRevenue IS NOT NULL OR PMRevenue IS NOT NULL OR PYRevenue IS NOT NULL
"""


M_TIME_CATEGORY = _time_by("CategoryName")

M_TIME_YEAR = with_golden(BOUNDS, SPINE, _MON, _BASE, """
t AS (SELECT *, LAG(TotalRevenue, 1) OVER (ORDER BY p) AS PMRevenue, LAG(TotalRevenue, 12) OVER (ORDER BY p) AS PYRevenue,
        LAG(TotalProfit, 1) OVER (ORDER BY p) AS PMProfit FROM base)""", """
ty AS (SELECT Year, SUM(TotalRevenue) AS TotalRevenue, SUM(TotalProfit) AS TotalProfit, SUM(PMRevenue) AS PMRevenue,
         SUM(PYRevenue) AS PYRevenue, SUM(PMProfit) AS PMProfit FROM t GROUP BY Year)""",
  "fx AS (SELECT " + ", ".join(f"SUM(CASE WHEN OrderYear = {k} THEN GrossRevenueUSD END) AS Revenue{k}" for k in _YEARS)
  + " FROM golden WHERE OrderDate IS NOT NULL)") + f"""
SELECT Year, {d('TotalRevenue')} AS TotalRevenue, {d('TotalProfit')} AS TotalProfit,
  {d('PMRevenue')} AS PMRevenue, {d('PYRevenue')} AS PYRevenue, {d('PMProfit')} AS PMProfit,
  {r(growth('TotalRevenue', 'PMRevenue'), 6)} AS MoMGrowthPct,
  {r(growth('TotalRevenue', 'PYRevenue'), 6)} AS YoYGrowthPct,
  {r(growth('TotalProfit', 'PMProfit'), 6)} AS MoMProfitGrowthPct,
  {_health(growth('TotalRevenue', 'PMRevenue'))} AS HealthStatus,
  """ + ", ".join(f"{d(f'Revenue{k}')} AS Revenue{k}" for k in _YEARS) + """
FROM ty, fx
WHERE TotalRevenue IS NOT NULL OR PMRevenue IS NOT NULL OR PYRevenue IS NOT NULL
"""

M_MA_YEAR = with_golden(BOUNDS, SPINE, _MON, _BASE, """
t AS (SELECT *, SUM(TotalRevenue) OVER (ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3 AS ma3,
        SUM(TotalRevenue) OVER (ORDER BY p ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 6 AS ma6 FROM base)""", """
yr AS (SELECT Year, SUM(TotalRevenue) AS TotalRevenue FROM base GROUP BY Year)""") + f"""
SELECT yr.Year, {d('yr.TotalRevenue')} AS TotalRevenue, {r('t.ma3', 6)} AS MA3Month, {r('t.ma6', 6)} AS MA6Month
FROM yr JOIN t ON t.Year = yr.Year AND t.Month = 12
WHERE t.ma3 IS NOT NULL OR t.ma6 IS NOT NULL
"""


# ---------------------------------------------------------------- evaluate
M_EVAL_CATEGORY = f"""
SELECT CategoryName, c.TotalRevenue, c.AvgOrderValue, o.OrderFulfillmentRate, a.AlertCritical, p.ParetoRatio
FROM (SELECT CategoryName, SUM(TotalRevenue) AS TotalRevenue FROM ({M_CORE}) GROUP BY CategoryName) x
JOIN ({with_golden()} SELECT CategoryName, {d('SUM(GrossRevenueUSD)')} AS TotalRevenue,
      {r(div('SUM(GrossRevenueUSD)', dcb('SalesOrderID'), '0.0'), 6)} AS AvgOrderValue FROM golden GROUP BY CategoryName) c USING (CategoryName)
JOIN ({M_OPS.replace('TerritoryName', 'CategoryName')}) o USING (CategoryName)
JOIN ({M_ANOMALY}) a USING (CategoryName) JOIN ({M_PARETO}) p USING (CategoryName)
"""

# Yearly rows of a key on every calendar year: previous year, the last three
# months of the year, weekend revenue.
M_EVAL_SEGMENT_YEAR = with_golden(RFM_C, RFM_S, RFM_SEG, BOUNDS, """
fact AS (SELECT seg.CustomerSegment AS k, g.* FROM golden g LEFT JOIN seg ON seg.CustomerID IS NOT DISTINCT FROM g.CustomerID
         WHERE OrderDate IS NOT NULL)""", f"""
yr AS (SELECT k, OrderYear AS y, SUM(GrossRevenueUSD) AS rev, {dcb('SalesOrderID')} AS n,
         SUM(GrossRevenueUSD) FILTER (OrderMonth >= 10) AS q4,
         SUM(GrossRevenueUSD) FILTER (dayofweek(OrderDate) IN (0, 6)) AS weekend FROM fact GROUP BY k, y)""", """
years AS (SELECT DISTINCT k, CAST(unnest(generate_series((SELECT year(s) FROM bounds), (SELECT year(e) FROM bounds))) AS INTEGER) AS y
          FROM fact)""") + f"""
SELECT s.k AS CustomerSegment, s.y AS Year, {d('a.rev')} AS TotalRevenue, a.n AS TotalOrders,
  {r(growth('a.rev', 'b.rev'), 6)} AS YoYGrowthPct, {r('a.q4 / 3', 6)} AS MA3Month, {d('a.weekend')} AS WeekendRevenue
FROM years s LEFT JOIN yr a ON a.k = s.k AND a.y = s.y LEFT JOIN yr b ON b.k = s.k AND b.y = s.y - 1
WHERE a.rev IS NOT NULL OR b.rev IS NOT NULL
"""

_ONLINE = "fact AS (SELECT * FROM golden WHERE IsOnlineOrder)"
M_EVAL_REGION_MONTH = with_golden(_ONLINE, BOUNDS.replace("FROM golden", "FROM fact"), SPINE, f"""
cell AS (SELECT TerritoryRegion AS k, OrderYear * 12 + OrderMonth - 1 AS p, SUM(GrossRevenueUSD) AS rev FROM fact GROUP BY 1, 2)""", f"""
buyer AS (SELECT TerritoryRegion AS k, OrderYear * 12 + OrderMonth - 1 AS p, CustomerID AS c, {dcb('SalesOrderID')} AS n
          FROM fact GROUP BY 1, 2, 3)""", """
crowd AS (SELECT k, p, COUNT(*) AS n, COUNT(*) FILTER (n > 1) AS again FROM buyer GROUP BY k, p)""", """
kept AS (SELECT x.k, x.p, COUNT(*) AS n FROM buyer x JOIN buyer z ON z.k = x.k AND z.c = x.c AND z.p = x.p - 1 GROUP BY x.k, x.p)""", """
grid AS (SELECT k, Year, Month, s.p, rev, SUM(rev) OVER (PARTITION BY k ORDER BY s.p ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 6 AS ma6,
           LAG(rev) OVER (PARTITION BY k ORDER BY s.p) AS pm, AVG(rev) OVER (PARTITION BY k, Year) AS mean
         FROM (SELECT DISTINCT k FROM cell) CROSS JOIN spine s LEFT JOIN cell USING (k, p))""") + f"""
SELECT g.k AS TerritoryRegion, g.Year, g.Month, {d('g.rev')} AS TotalRevenue,
  CASE WHEN g.rev IS NOT NULL OR g.pm IS NOT NULL OR y.rev IS NOT NULL THEN {r(growth('g.rev', 'g.pm'), 6)} END AS MoMGrowthPct,
  CASE WHEN c.n IS NOT NULL OR b.n IS NOT NULL THEN {r(div('COALESCE(kept.n, 0)', 'b.n', '0.0'), 6)} END AS RetentionRate,
  CASE WHEN c.n IS NOT NULL OR b.n IS NOT NULL THEN {r(div('c.again', 'c.n', '0.0'), 6)} END AS RepeatCustomerPct,
  {r('g.ma6', 6)} AS MA6Month,
  CASE WHEN g.rev IS NOT NULL OR g.ma6 IS NOT NULL THEN {_trend('g.rev', 'g.ma6')} END AS TrendDirection,
  CASE WHEN g.rev IS NOT NULL THEN {r(div('g.rev', 'g.mean'), 6)} END AS SeasonalIndex
FROM grid g LEFT JOIN crowd c ON c.k = g.k AND c.p = g.p LEFT JOIN crowd b ON b.k = g.k AND b.p = g.p - 1
LEFT JOIN kept ON kept.k = g.k AND kept.p = g.p LEFT JOIN cell y ON y.k = g.k AND y.p = g.p - 12
WHERE g.rev IS NOT NULL OR g.pm IS NOT NULL OR y.rev IS NOT NULL OR g.ma6 IS NOT NULL OR b.n IS NOT NULL
"""
