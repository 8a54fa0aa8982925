"""Oracle SQL of `evaluate`: each measure from its definition, by joining every
(member, period) of a dense grid with the rows its date range holds."""

from .cleaning import SQL as CLEANING
from .common import BOUNDS, d, div, growth, r, with_golden
from .measures import RFM_C, RFM_S, RFM_SEG, _health
from .reports import GOLDEN_SELECT

_DAY = "OrderDate"
# Grain: columns, periods of the calendar as (columns, first day, last day).
GRAINS = {
    "Year": "CAST(year(x) AS INTEGER) AS Year, CAST(x AS DATE) AS lo, CAST(x + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS hi",
    "Quarter": "CAST(year(x) AS INTEGER) AS Year, CAST(quarter(x) AS INTEGER) AS Quarter, CAST(x AS DATE) AS lo, "
               "CAST(x + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS hi",
    "Month": "CAST(year(x) AS INTEGER) AS Year, CAST(month(x) AS INTEGER) AS Month, CAST(x AS DATE) AS lo, "
             "CAST(x + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS hi",
    "Date": "CAST(x AS DATE) AS Date, CAST(x AS DATE) AS lo, CAST(x AS DATE) AS hi",
}
_STEP = {"Year": "1 YEAR", "Quarter": "3 MONTH", "Month": "1 MONTH", "Date": "1 DAY"}
_COLUMNS = {"Year": ["Year"], "Quarter": ["Year", "Quarter"], "Month": ["Year", "Month"], "Date": ["Date"]}


def _back(n: int, grain: str) -> tuple[str, str]:
    """The range n months earlier: whole months stay whole, a day keeps its number."""
    if grain == "Date":
        return f"CAST(lo - INTERVAL {n} MONTH AS DATE)", f"CAST(hi - INTERVAL {n} MONTH AS DATE)"
    return f"CAST(lo - INTERVAL {n} MONTH AS DATE)", f"CAST(date_trunc('month', hi) - INTERVAL {n - 1} MONTH - INTERVAL 1 DAY AS DATE)"


def _last_months(n: int) -> tuple[str, str]:
    """DATESINPERIOD(LASTDATE, -n, MONTH): from the day after the last date n
    months earlier; from a month's start if the last date is a month's end."""
    end = f"CASE WHEN hi = last_day(hi) AND lo < hi THEN CAST(date_trunc('month', hi) - INTERVAL {n - 1} MONTH AS DATE) " \
          f"ELSE CAST(hi - INTERVAL {n} MONTH + INTERVAL 1 DAY AS DATE) END"
    return end, "hi"


# VAR.P from exact sums: a running estimate differs in the last digits from run to run.
_SUM = "CAST(SUM(GrossRevenueUSD) AS DOUBLE)"
_VARIANCE = (f"(CAST(SUM(CAST(GrossRevenueUSD AS DECIMAL(19,6)) * CAST(GrossRevenueUSD AS DECIMAL(19,6))) AS DOUBLE) "
             f"- {_SUM} * {_SUM} / COUNT(GrossRevenueUSD)) / COUNT(GrossRevenueUSD)")


def statement(keys: list[str], grain: str | None, columns: dict[str, str], there: str, ranges: dict[str, tuple[str, str]] | None = None,
              customers: bool = False, segment: bool = False, more: str = "",
              date: str = _DAY) -> str:
    """``columns``: name -> expression over the grid row ``q`` and its ranges:
    now_rev, now_n, now_prof, now_qty, now_orders and, for each further range,
    <range>_rev, <range>_n, <range>_prof; customers, before, kept, again, last."""
    ks = ", ".join(keys)
    same = " AND ".join(f"{{a}}.{k} IS NOT DISTINCT FROM {{b}}.{k}" for k in keys) or "TRUE"
    on = lambda a, b: same.format(a=a, b=b)
    pre = (ks + ", ") if keys else ""
    source = "golden g LEFT JOIN seg ON seg.CustomerID IS NOT DISTINCT FROM g.CustomerID" if segment else "golden g"
    cols = "g.*, seg.CustomerSegment" if segment else "g.*"
    ctes = [RFM_C, RFM_S, RFM_SEG] if segment else []
    dated = f"WHERE {date} IS NOT NULL" if grain else ""
    if date != _DAY:
        cols = f"g.* REPLACE ({date} AS {_DAY})"
    ctes += [BOUNDS, f"fact AS (SELECT {cols} FROM {source} {dated})"]
    if grain:
        ctes += [f"periods AS (SELECT {GRAINS[grain]} FROM (SELECT unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), "
                 f"INTERVAL {_STEP[grain]})) AS x FROM bounds))"]
    else:
        ctes += ["periods AS (SELECT DATE '0001-01-01' AS lo, DATE '9999-12-31' AS hi)"]
    ctes += [f"members AS (SELECT DISTINCT {ks or '1 AS one'} FROM fact)", "grid AS (SELECT * FROM members CROSS JOIN periods)"]
    day = "COALESCE(OrderDate, DATE '2000-01-01')" if not grain else _DAY
    ctes += [f"""daily AS (SELECT {pre}{day} AS day, SUM(GrossRevenueUSD) AS rev, COUNT(GrossRevenueUSD) AS n,
         SUM(EstimatedNetProfitUSD) AS prof FROM fact GROUP BY {pre}day)"""]
    at = ", ".join([f"q.{k}" for k in keys] + ["q.lo"])
    joins = ""
    for name, (lo, hi) in (ranges or {}).items():
        ctes += [f"""r_{name} AS (SELECT {at}, SUM(rev) AS {name}_rev, SUM(n) AS {name}_n, SUM(prof) AS {name}_prof
         FROM (SELECT *, {lo} AS f, {hi} AS t FROM grid) q JOIN daily z ON {on('q', 'z')} AND z.day BETWEEN q.f AND q.t GROUP BY {at})"""]
        joins += f" LEFT JOIN r_{name} ON {on('q', 'r_' + name)} AND r_{name}.lo = q.lo"
    ctes += [f"""now AS (SELECT {at}, COUNT(*) AS now_rows, SUM(GrossRevenueUSD) AS now_rev, COUNT(GrossRevenueUSD) AS now_n,
         SUM(EstimatedNetProfitUSD) AS now_prof, SUM(OrderQty) AS now_qty,
         COUNT(DISTINCT SalesOrderID) + MAX(CASE WHEN SalesOrderID IS NULL THEN 1 ELSE 0 END) AS now_orders,
         AVG(GrossRevenueUSD) AS now_mean, {_VARIANCE} AS now_var, MAX(OrderDate) AS last,
         COUNT(DISTINCT z.ProductName) + MAX(CASE WHEN z.ProductName IS NULL THEN 1 ELSE 0 END) AS now_products
         FROM grid q JOIN fact z ON {on('q', 'z')} AND {'z.OrderDate BETWEEN q.lo AND q.hi' if grain else 'TRUE'} GROUP BY {at})"""]
    joins += f" LEFT JOIN now ON {on('q', 'now')} AND now.lo = q.lo"
    if customers:
        lo, hi = _back(1, grain)
        for name, f, t in (("cur", "lo", "hi"), ("prev", lo, hi)):
            ctes += [f"""{name} AS (SELECT {at}, CustomerID AS c, COUNT(DISTINCT SalesOrderID) AS n
         FROM (SELECT *, {f} AS f, {t} AS t FROM grid) q JOIN fact z ON {on('q', 'z')} AND z.OrderDate BETWEEN q.f AND q.t GROUP BY {at}, c)"""]
        ctes += [f"crowd AS (SELECT {at}, COUNT(*) AS customers, COUNT(*) FILTER (n > 1) AS again FROM cur q GROUP BY {at})",
                 f"earlier AS (SELECT {at}, COUNT(*) AS before FROM prev q GROUP BY {at})",
                 f"""both_ AS (SELECT {at}, COUNT(*) AS kept FROM cur q JOIN prev w ON {on('q', 'w')} AND q.lo = w.lo
         AND q.c IS NOT DISTINCT FROM w.c GROUP BY {at})"""]
        for name in ("crowd", "earlier", "both_"):
            joins += f" LEFT JOIN {name} ON {on('q', name)} AND {name}.lo = q.lo"
    shown = keys + (_COLUMNS[grain] if grain else [])
    if more:
        ctes += [f"whole AS (SELECT q.*, " + ", ".join(_values(ranges, customers)) + f" FROM grid q{joins})", *more.split(";;")[:-1]]
        tail = more.split(";;")[-1]
        return with_golden(*ctes) + f"SELECT {', '.join('q.' + c for c in shown)}, " + ", ".join(
            f"{x} AS {n}" for n, x in columns.items()) + f" FROM whole q{tail} WHERE {there}"
    return with_golden(*ctes) + f"SELECT {', '.join('q.' + c for c in shown)}, " + ", ".join(
        f"{x} AS {n}" for n, x in columns.items()) + f" FROM grid q{joins} WHERE {there}"


def _values(ranges, customers) -> list[str]:
    out = ["now_rows", "now_rev", "now_n", "now_prof", "now_qty", "now_orders", "now_mean", "now_var", "now_products", "last"]
    out += [f"{r_}_{s}" for r_ in (ranges or {}) for s in ("rev", "n", "prof")]
    return out + (["customers", "again", "before", "kept"] if customers else [])


def _if(there: str, value: str) -> str:
    return f"CASE WHEN {there} THEN {value} END"


def _time_there(*roles: str) -> str:
    return "(" + " OR ".join(f"COALESCE({x}_n, 0) > 0" for x in roles) + ")"


_ROWS, _TIME = "now_rows > 0", _time_there("now", "pm", "py")
_CUST = "(COALESCE(customers, 0) > 0 OR COALESCE(before, 0) > 0)"


def _time_columns(names) -> dict[str, str]:
    every = {
        "PMRevenue": d("pm_rev"), "PYRevenue": d("py_rev"), "PMProfit": d("pm_prof"),
        "MoMGrowthPct": r(growth("now_rev", "pm_rev"), 6), "YoYGrowthPct": r(growth("now_rev", "py_rev"), 6),
        "MoMProfitGrowthPct": r(growth("now_prof", "pm_prof"), 6), "HealthStatus": _health(growth("now_rev", "pm_rev")),
    }
    return {n: _if(_TIME, every[n]) for n in names}


def _ma_columns() -> dict[str, str]:
    return {f"MA{k}Month": _if(f"ma{k}_n > 0", r(f"ma{k}_rev / {k}", 6)) for k in (3, 6)}


_RETENTION = {
    "RetentionRate": _if(_CUST, r(div("COALESCE(kept, 0)", "before", "0.0"), 6)),
    "RepeatCustomerPct": _if(_CUST, r(div("again", "customers", "0.0"), 6)),
    "DaysSinceLastOrder": _if(_CUST, "CAST(date_diff('day', last, (SELECT MAX(OrderDate) FROM golden)) AS INTEGER)"),
}


def _ranges(grain: str, *names: str) -> dict[str, tuple[str, str]]:
    every = {"pm": _back(1, grain), "py": _back(12, grain), "ma3": _last_months(3), "ma6": _last_months(6)}
    if grain == "Date":
        every |= {f"ma{k}": (f"CAST(lo - INTERVAL {k} MONTH + INTERVAL 1 DAY AS DATE)", "hi") for k in (3, 6)}
    return {n: every[n] for n in names}


_FOUR = ("pm", "py", "ma3", "ma6")
_ANY = f"({_ROWS} OR {_TIME} OR ma3_n > 0 OR ma6_n > 0)"

M_EVAL_QUARTER = statement(
    ["TerritoryRegion"], "Quarter",
    {"TotalRevenue": _if(_ROWS, d("now_rev")), "TotalOrders": _if(_ROWS, "now_orders"),
     **_time_columns(("PMRevenue", "PYRevenue", "PMProfit", "MoMGrowthPct", "YoYGrowthPct", "MoMProfitGrowthPct", "HealthStatus")),
     **_ma_columns(), **_RETENTION}, f"({_ANY} OR {_CUST})", _ranges("Quarter", *_FOUR), customers=True)

M_EVAL_DAY = statement(
    ["CustomerType"], "Date",
    {"TotalRevenue": _if(_ROWS, d("now_rev")), "TotalOrders": _if(_ROWS, "now_orders"),
     **_time_columns(("PMRevenue", "PYRevenue", "MoMGrowthPct", "YoYGrowthPct", "HealthStatus")), **_ma_columns(),
     "Revenue1997": _if(_TIME, d("CASE WHEN year(q.lo) = 1997 THEN now_rev END"))}, _ANY, _ranges("Date", *_FOUR))

M_EVAL_RETENTION_YEAR = statement(
    ["CustomerType"], "Year", {"TotalCustomers": _if(_ROWS, "customers"), **_RETENTION}, f"({_ROWS} OR {_CUST})", customers=True)

M_EVAL_RETENTION_MONTH_ALL = statement(
    [], "Month", {"TotalCustomers": _if(_ROWS, "customers"), **_RETENTION}, f"({_ROWS} OR {_CUST})", customers=True)


# --- measures that change the filter context ---------------------------------

def _top(keys: list[str], grain: str | None) -> str:
    """CTEs and join of TOPN over ALL(ProductName): the revenue of products that
    reach the N-th highest, N a fifth of their number, rounded up."""
    at = [*keys, "lo"]
    same = " AND ".join(f"{{a}}.{k} IS NOT DISTINCT FROM {{b}}.{k}" for k in at)
    a = ", ".join(at)
    qa = ", ".join(f"q.{k}" for k in at)
    on = " AND ".join(f"q.{k} IS NOT DISTINCT FROM z.{k}" for k in keys) or "TRUE"
    within = "AND z.OrderDate BETWEEN q.lo AND q.hi" if grain else ""
    return f"""by_product AS (SELECT {qa}, ProductName, SUM(GrossRevenueUSD) AS rev FROM grid q JOIN fact z ON {on} {within}
         GROUP BY {qa}, ProductName);;
nth AS (SELECT {a}, rev AS least FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {a} ORDER BY rev DESC NULLS LAST) AS k,
         COUNT(*) OVER (PARTITION BY {a}) AS n FROM by_product) WHERE k = CAST(ceil(n * 0.2) AS BIGINT));;
tops AS (SELECT {", ".join("p." + k for k in at)}, SUM(p.rev) AS top FROM by_product p JOIN nth ON {same.format(a="p", b="nth")}
         AND p.rev >= nth.least GROUP BY {", ".join("p." + k for k in at)});;
 LEFT JOIN tops ON {same.format(a="q", b="tops")}"""


_Z = r(div("COALESCE(now_mean, 0) - (SELECT AVG(GrossRevenueUSD) FROM golden)", "(SELECT STDDEV_POP(GrossRevenueUSD) FROM golden)", "0.0"), 6)


def _over(state: str, *columns: str) -> str:
    return f"SUM({state}) OVER (PARTITION BY {', '.join('q.' + c for c in columns)})" if columns else f"SUM({state}) OVER ()"


M_CTX_SEGMENT_QUARTER = statement(
    ["CustomerSegment"], "Quarter",
    {"TotalRevenue": d("now_rev"), "CustomerLTV": d(_over("now_rev", "CustomerSegment", "Year")),
     "RevenueZScore": _Z, "RevenueVariance": r("now_var", 4), "SelectionSharePct": r(div("now_rev", _over("now_rev"), "0.0"), 6),
     "Top20ProductsRevenue": d("top"), "ProductCount": "now_products"},
    _ROWS, segment=True, more=_top(["CustomerSegment"], "Quarter"))

M_CTX_PRODUCT_YEAR = statement(
    ["CategoryName", "ProductName"], "Year",
    {"TotalRevenue": d("now_rev"), "ProductContributionPct": r(div("now_rev", _over("now_rev", "CategoryName", "Year"), "0.0"), 6),
     "ProductVelocity": r(div("now_qty", "now_orders", "0.0"), 6), "CustomerLTV": d(_over("now_rev", "Year")), "RevenueZScore": _Z,
     "RevenueVariance": r("now_var", 4)}, _ROWS, more=" ")

M_CTX_PRODUCT_COLOR = statement(
    ["ProductColor", "ProductName"], None,
    {"ProductContributionPct": r(div("now_rev", _over("now_rev", "ProductColor"), "0.0"), 6),
     "ProductVelocity": r(div("now_qty", "now_orders", "0.0"), 6), "RevenueZScore": _Z}, _ROWS, more=" ")


def _ranked(keys: list[str], grain: str) -> str:
    """The dense rank of every territory of the record in each context, those
    without rows included."""
    rest = [c for c in keys if c != "TerritoryName"] + ["lo"]
    g_ = growth("now_rev", "py_rev")
    spots = ", ".join(f"a.{c}" for c in rest)
    same = " AND ".join(f"m.{c} IS NOT DISTINCT FROM a.{c}" for c in rest)
    again = " AND ".join(f"q.{c} IS NOT DISTINCT FROM ranks.{c}" for c in (*rest, "TerritoryName"))
    return f"""lands AS (SELECT DISTINCT TerritoryName FROM fact);;
spots AS (SELECT DISTINCT {', '.join(rest)} FROM whole);;
ranks AS (SELECT {spots}, l.TerritoryName, DENSE_RANK() OVER (PARTITION BY {spots} ORDER BY {g_} DESC) AS rank
         FROM spots a CROSS JOIN lands l LEFT JOIN whole m ON {same} AND m.TerritoryName IS NOT DISTINCT FROM l.TerritoryName);;
 LEFT JOIN ranks ON {again}"""


M_CTX_TERRITORY_QUARTER = statement(
    ["TerritoryName"], "Quarter",
    {"TotalRevenue": _if(_ROWS, d("now_rev")), "YoYGrowthPct": r(growth("now_rev", "py_rev"), 6),
     "TerritoryGrowthRank": "CAST(rank AS INTEGER)"}, _TIME, _ranges("Quarter", "pm", "py"), more=_ranked(["TerritoryName"], "Quarter"))

M_CTX_TYPE_TERRITORY_YEAR = statement(
    ["CustomerType", "TerritoryName"], "Year",
    {"TotalRevenue": _if(_ROWS, d("now_rev")), "TerritoryGrowthRank": "CAST(rank AS INTEGER)",
     "CustomerLTV": _if(_ROWS, d(_over("now_rev", "Year")))},
    _TIME, _ranges("Year", "pm", "py"), more=_ranked(["CustomerType", "TerritoryName"], "Year"))

M_CTX_TYPE_MONTH = statement(
    ["CustomerType"], "Month",
    {"CustomerLTV": d(_over("now_rev", "Year")), "Top20ProductsRevenue": d("top"),
     "ParetoRatio": r(div("top", "now_rev", "0.0") + " * 100", 6)}, _ROWS, more=_top(["CustomerType"], "Month"))

M_SHIP_ROLE = statement(
    [], "Month",
    {"TotalRevenue": d("now_rev"), "TotalProfit": d("now_prof"),
     **_time_columns(("PMRevenue", "PYRevenue", "PMProfit", "MoMGrowthPct", "YoYGrowthPct", "MoMProfitGrowthPct", "HealthStatus")),
     **{f"Revenue{k}": d(f"(SELECT SUM(rev) FROM daily WHERE year(day) = {k} AND month(day) = q.Month)") for k in (2022, 2023, 2024, 2025)}},
    _TIME, _ranges("Month", "pm", "py"), date="ShipDate")

_LAST = "(SELECT MAX(OrderDate) FROM golden)"
_MONTHS_END = "(SELECT last_day(e - INTERVAL 1 MONTH) FROM bounds)"
M_SCENARIO_REGION = with_golden(BOUNDS, f"""
steps AS (SELECT CAST(-0.50 + 0.05 * i AS DECIMAL(4,2)) AS sv FROM range(0, 21) t(i))""", f"""
card AS (SELECT TerritoryRegion, SUM(GrossRevenueUSD) AS rev, SUM(GrossRevenueUSD) FILTER (OrderDate <= {_MONTHS_END}) AS pm,
  SUM(GrossRevenueUSD) FILTER (OrderDate > (SELECT e - INTERVAL 6 MONTH FROM bounds)) AS half,
  SUM(GrossRevenueUSD) FILTER (date_trunc('month', OrderDate) = date_trunc('month', {_LAST})) AS recent FROM golden GROUP BY 1)""") + f"""
SELECT TerritoryRegion, CAST(sv AS DOUBLE) AS ScenarioValue,
  CASE WHEN sv > 0.20 THEN '🚀 Aggressive Growth' WHEN sv > 0.05 THEN '📈 Optimistic' WHEN sv > -0.05 THEN '📊 Base Case'
       WHEN sv > -0.20 THEN '⚠️ Conservative' ELSE '🔴 Pessimistic' END AS ScenarioLabel,
  {r(growth('rev', 'pm'), 6)} AS MoMGrowthPct,
  {r(f"CAST(half / 6 AS DOUBLE) * (1 + {growth('rev', 'pm')} + CAST(sv AS DOUBLE))", 4)} AS ForecastNextMonth,
  {r(div('recent', f"day({_LAST})") + f" * day(last_day({_LAST})) * (1 + {growth('rev', 'pm')} + CAST(sv AS DOUBLE))", 0)} AS RevenueProjection
FROM card CROSS JOIN steps"""

# The calendar of the driver's tables, for the columns of the two matrices.
_CALENDAR = range(1995, 2002)


def _matrix(row: str) -> str:
    return with_golden() + f"SELECT {row}, " + ", ".join(
        d(f"SUM(CASE WHEN OrderYear = {y} THEN GrossRevenueUSD END)") + f' AS "{y}"' for y in _CALENDAR
    ) + " FROM golden WHERE OrderDate IS NOT NULL GROUP BY 1"


G5_MATRIX, G6_HEATMAP = _matrix("TerritoryName"), _matrix("OrderMonth AS Month")

VIEWS = f"""SELECT TerritoryRegion, CurrencyCode, COUNT(*) AS Lines, COUNT(DISTINCT SalesOrderID) AS Orders,
  COUNT(DISTINCT CustomerEmail) AS Emails, CAST(SUM(OrderQty) AS BIGINT) AS Quantity
FROM ({CLEANING['golden_generic']}) GROUP BY TerritoryRegion, CurrencyCode"""

SQL = {
    "m_ship_role": M_SHIP_ROLE, "m_scenario_region": M_SCENARIO_REGION, "g5_matrix": G5_MATRIX, "g6_heatmap": G6_HEATMAP, "views": VIEWS, "golden_refresh": GOLDEN_SELECT,
    "m_eval_quarter": M_EVAL_QUARTER, "m_eval_day": M_EVAL_DAY, "m_eval_retention_year": M_EVAL_RETENTION_YEAR,
    "m_eval_retention_month": M_EVAL_RETENTION_MONTH_ALL,
    "m_ctx_segment_quarter": M_CTX_SEGMENT_QUARTER, "m_ctx_product_year": M_CTX_PRODUCT_YEAR,
    "m_ctx_product_color": M_CTX_PRODUCT_COLOR, "m_ctx_territory_quarter": M_CTX_TERRITORY_QUARTER,
    "m_ctx_type_territory_year": M_CTX_TYPE_TERRITORY_YEAR, "m_ctx_type_month": M_CTX_TYPE_MONTH,
}
