"""Measures at any grain from one pass over the record.

`evaluate` builds one shared base aggregate and derives every measure from it.

1. *Orders.*  Lines -> (keys, date, customer, order): an order has one customer
   and one date, as columns of its header.  From here on distinct orders are
   counts of rows, and distinct customers the rows of the next level: several
   distinct counts without an Expand, and every state merges to any period.
2. *Units.*  -> (keys, unit, customer), a unit being a month, or a day when the
   grain is Date.  Customer segments, a column calculated over all of a
   customer's rows, are assigned here by a window over a customer's units.
3. *Roles.*  Time intelligence shifts dates.  Instead of looking back from each
   period, a unit's sums are sent to the periods that will look at it: DATEADD(-1
   MONTH) of March reads February, so February goes to March in the role "pm".
   The same holds for sets: a customer of February goes to February as "current"
   and to March as "previous", and retention is the intersection of both, for
   any period.  DATESINPERIOD at days would send a day to a quarter of a year of
   others: there per-key running sums are sent, and a window is the difference
   of two of them.
4. *Cells.*  -> (keys, period): one row with every role's sums.  A measure is an
   expression over a cell, and BLANK where its own roles have no rows.

Measures that change the filter context read the cells through `context`; the
cells are then written once, as several plans read them.  So are products,
which take a second lane of the same pass.

The calendar and the latest order date are those of the whole record: a
selection filters the fact, not the date table, and ALL(fact) lifts it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import day_diff, divide, round_half_up
from ..operators.stats import known, scalar
from ..session import materialized
from . import measures as M
from .calendar import calendar_bounds
from .context import ROW, calculate, dense_rank_over
from .golden import latest_order_date

REV, PROF = M.REV, M.PROF
SQUARE = "decimal(38,12)"

# --- grains ------------------------------------------------------------------
# A period's number from the number of its unit (months or days since year 0 or
# 1970), its columns from that number, and the shift back to its first unit.


@dataclass(frozen=True)
class Grain:
    columns: tuple[str, ...]
    months: int = 0  # units in a period; 0: days

    def period(self, unit: Column) -> Column:
        return F.floor(unit / self.months).cast("int") if self.months > 1 else unit

    def show(self, period: Column) -> dict[str, Column]:
        if not self.columns:
            return {}
        if self.columns == ("Date",):
            return {"Date": F.date_from_unix_date(period)}
        first = period * self.months
        out = {"Year": F.floor(first / 12).cast("int"), "Month": (first % 12 + 1).cast("int"),
               "Quarter": (F.floor(first % 12 / 3) + 1).cast("int")}
        return {c: out[c] for c in self.columns}


NONE, DATE = Grain(()), Grain(("Date",))
GRAINS = (NONE, Grain(("Year",), 12), Grain(("Year", "Quarter"), 3), Grain(("Year", "Month"), 1), DATE)


def grain_of(by: list[str]) -> Grain:
    found = {c for c in by if c in ("Year", "Quarter", "Month", "Date")}
    for grain in GRAINS:
        if set(grain.columns) == found:
            return grain
    raise ValueError(f"not a grain of the calendar: {sorted(found)}")


# --- states ------------------------------------------------------------------

def line_states(mu: Column | None, sd: Column | None) -> dict[str, Column]:
    """Additive states of a line."""
    rev, prof = F.col(REV), F.col(PROF)

    def n(c: Column) -> Column:
        return F.when(c, 1).otherwise(0).cast("long")

    def square(c: Column) -> Column:
        return (c.cast("decimal(18,6)") * c.cast("decimal(18,6)")).cast(SQUARE)
    weekend = F.dayofweek("OrderDate").isin(1, 7)
    out = {"rows": F.lit(1).cast("long"), "rev": rev, "rev_n": n(rev.isNotNull()), "rev2": square(rev),
           "prof": prof, "prof_n": n(prof.isNotNull()), "prof2": square(prof), "qty": F.col("OrderQty").cast("long"),
           "ship": F.col("DaysToShip").cast("long"), "ship_n": n(F.col("DaysToShip").isNotNull()),
           "disc": F.col("UnitPriceDiscount"), "disc_n": n(F.col("UnitPriceDiscount").isNotNull()),
           "weekend": F.when(weekend, rev), "weekend_n": n(weekend & rev.isNotNull()),
           "weekday": F.when(~weekend, rev), "weekday_n": n(~weekend & rev.isNotNull())}
    if mu is not None:
        z = divide(M._blank0(rev).cast("double") - mu, sd, 0.0)
        az = F.abs(z)
        out |= {"z_out": n(az > M.Z_OUTLIER), "z_pos": n(z > M.Z_OUTLIER), "z_neg": n(z < -M.Z_OUTLIER),
                "z_crit": n(az > M.Z_CRITICAL), "z_warn": n((az > M.Z_OUTLIER) & (az <= M.Z_CRITICAL)),
                "z_norm": n(az <= M.Z_OUTLIER)}
    return out


ORDER_STATES = ("orders", "shipped")  # of orders with a number; BLANK ones are flags
ORDER_FLAGS = ("blank", "blank_shipped")


# --- measures ----------------------------------------------------------------

@dataclass(frozen=True)
class Measure:
    """``value`` and ``there`` (has the measure a row here?) over a cell; the
    states of each role and the other parts of the base that it reads."""

    value: object
    there: object
    states: dict[str, tuple[str, ...]] = field(default_factory=dict)
    parts: tuple[str, ...] = ()
    grains: tuple[str, ...] = ("", "Year", "Quarter", "Month", "Date")


def _s(state: str, role: str = "now") -> Column:
    return F.col(f"{role}_{state}")


def _sum(state: str, role: str = "now") -> Column:
    """SUM: BLANK without values."""
    return F.when(_s(f"{state}_n", role) > 0, _s(state, role))


def _distinct_orders(state="orders", blank="blank") -> Column:
    return _s(state) + _s(blank)


def _mean(state: str) -> Column:
    return _s(state).cast("double") / F.when(_s(f"{state}_n") > 0, _s(f"{state}_n"))


def _variance(state: str) -> Column:
    """VAR.P from the sums of values and squares."""
    n = F.when(_s(f"{state}_n") > 0, _s(f"{state}_n"))
    total = _s(state).cast("double")
    return F.greatest((_s(f"{state}2").cast("double") - total * total / n) / n, F.lit(0.0))


def _r6(c: Column) -> Column:
    return round_half_up(c, 6)


def _has_rows() -> Column:
    return _s("rows") > 0


def _any(*roles: str, state: str = "rev_n"):
    return lambda: sum((_s(state, r) for r in roles[1:]), _s(state, roles[0])) > 0


_AMOUNT, _PROFIT, _ORDERS = ("rev", "rev_n"), ("prof", "prof_n"), (*ORDER_STATES, *ORDER_FLAGS)
_SHIFTED = {"now": ("rows", *_AMOUNT, *_PROFIT), "pm": (*_AMOUNT, *_PROFIT), "py": _AMOUNT}


def _core(value, *states: str, parts=()) -> Measure:
    return Measure(value, _has_rows, {"now": ("rows", *states)}, parts)


def _time(value) -> Measure:
    return Measure(value, _any("now", "pm", "py"), _SHIFTED, grains=("Year", "Quarter", "Month", "Date"))


def _mom() -> Column:
    return M._growth(_sum("rev"), _sum("rev", "pm"))


def _yoy() -> Column:
    return M._growth(_sum("rev"), _sum("rev", "py"))


def _ma(months: int) -> Column:
    return _sum("rev", f"ma{months}") / months


def _forecast(value, *states: str, parts=()) -> Measure:
    return Measure(value, _any("now", "ma6"), {"now": ("rows", *_AMOUNT, *states), "pm": _AMOUNT, "ma6": _AMOUNT}, parts, ("Month",))


def _customers(value, *states: str) -> Measure:
    return Measure(value, lambda: (F.col("customers") > 0) | (F.col("before") > 0), {"now": ("rows", *states)}, ("customers", "before"),
                   ("Year", "Quarter", "Month"))


def _confidence() -> Column:
    spread = F.try_divide(F.col("_sd"), _mean("rev"))
    (low, high), (mid, medium) = M.CONFIDENCE
    return F.when(spread < low, F.lit(high)).when(spread < mid, F.lit(medium)).otherwise(F.lit(M.CONFIDENCE_ELSE))


MEASURES: dict[str, Measure] = {
    "TotalRevenue": _core(lambda: _sum("rev"), *_AMOUNT),
    "TotalProfit": _core(lambda: _sum("prof"), *_PROFIT),
    "TotalOrders": _core(_distinct_orders, *_ORDERS),
    "TotalCustomers": _core(lambda: F.col("customers"), parts=("customers",)),
    "TotalQuantity": _core(lambda: _s("qty"), "qty"),
    "ProductCount": _core(lambda: F.col("_products"), parts=("products",)),
    "ProfitMarginPct": _core(lambda: _r6(divide(_sum("prof"), _sum("rev"), 0.0)), *_AMOUNT, *_PROFIT),
    "AvgOrderValue": _core(lambda: _r6(divide(_sum("rev"), _distinct_orders(), 0.0)), *_AMOUNT, *_ORDERS),
    "AvgRevenuePerTransaction": _core(lambda: _r6(divide(_sum("rev"), _s("rows"), 0.0)), *_AMOUNT),
    "MeanRevenue": _core(lambda: _r6(_mean("rev")), *_AMOUNT),
    "AvgProcessingDays": _core(lambda: _r6(_mean("ship")), "ship", "ship_n"),
    "AvgOrdersPerDay": _core(lambda: _r6(F.col("per_day")), parts=("days",)),
    "AvgItemsPerOrder": _core(lambda: _r6(divide(_s("qty"), _distinct_orders(), 0.0)), "qty", *_ORDERS),
    "OrderFulfillmentRate": _core(lambda: _r6(divide(_distinct_orders("shipped", "blank_shipped"), _distinct_orders(), 0.0)), *_ORDERS),
    "OrdersPerDay": _core(lambda: _r6(divide(_distinct_orders(), F.col("_calendar_days"), 0.0)), *_ORDERS),
    "AvgDiscountPct": _core(lambda: _r6(_mean("disc")), "disc", "disc_n"),
    "RevenueStdDev": _core(lambda: _r6(F.col("_sd")), parts=("spread",)),
    "RevenueVariance": _core(lambda: round_half_up(_variance("rev"), 4), *_AMOUNT, "rev2"),
    "RevenueZScore": _core(lambda: _r6(divide(M._blank0(_mean("rev")) - F.col("_mu"), F.col("_sd"), 0.0)), *_AMOUNT, parts=("spread",)),
    "OutlierPctOfTotal": _core(lambda: _r6(divide(_s("z_out"), _s("rows"), 0.0)), "z_out", parts=("spread",)),
    **{name: _core(lambda s=s: _s(s), s, parts=("spread",)) for name, s in {
        "CountOfOutliers": "z_out", "PositiveOutliers": "z_pos", "NegativeOutliers": "z_neg", "AlertCritical": "z_crit",
        "AlertWarning": "z_warn", "AlertNormal": "z_norm"}.items()},
    "Top20ProductsRevenue": _core(lambda: F.col("_top"), parts=("products",)),
    "ParetoRatio": _core(lambda: _r6(divide(F.col("_top"), _sum("rev"), 0.0) * 100), *_AMOUNT, parts=("products",)),
    "PMRevenue": _time(lambda: _sum("rev", "pm")),
    "PYRevenue": _time(lambda: _sum("rev", "py")),
    "PMProfit": _time(lambda: _sum("prof", "pm")),
    "MoMGrowthPct": _time(lambda: _r6(_mom())),
    "YoYGrowthPct": _time(lambda: _r6(_yoy())),
    "MoMProfitGrowthPct": _time(lambda: _r6(M._growth(_sum("prof"), _sum("prof", "pm")))),
    "HealthStatus": _time(lambda: M._ladder_gt(_mom(), M.HEALTH_STATUS, M.HEALTH_STATUS_ELSE)),
    **{f"MA{k}Month": Measure(lambda k=k: _r6(_ma(k)), _any(f"ma{k}"), {"now": ("rows",), f"ma{k}": _AMOUNT},
                              grains=("Year", "Quarter", "Month", "Date")) for k in (3, 6)},
    "RetentionRate": _customers(lambda: _r6(divide(F.col("kept"), F.when(F.col("before") > 0, F.col("before")), 0.0))),
    "RepeatCustomerPct": _customers(lambda: _r6(divide(F.col("again"), F.when(F.col("customers") > 0, F.col("customers")), 0.0))),
    "DaysSinceLastOrder": _customers(lambda: day_diff(F.col("last"), F.col("_latest"))),
    "ForecastNextMonth": _forecast(lambda: round_half_up(_ma(6).cast("double") * (1 + _mom()), 4)),
    "ProfitVolatility": _forecast(lambda: _r6(F.try_divide(F.sqrt(_variance("prof")), _mean("prof"))), *_PROFIT, "prof2"),
    "ForecastConfidence": _forecast(_confidence, parts=("spread",)),
    "TrendDirection": _forecast(lambda: M._trend(_sum("rev"), _ma(6))),
    "SeasonalIndex": Measure(lambda: _r6(divide(_sum("rev"), F.col("_year_mean"))), _has_rows, {"now": ("rows", *_AMOUNT)},
                             ("season",), ("Month",)),
    "WeekdayRevenue": _core(lambda: _sum("weekday"), "weekday", "weekday_n"),
    "WeekendRevenue": _core(lambda: _sum("weekend"), "weekend", "weekend_n"),
    # Measures that change the filter context.
    "CustomerLTV": _core(lambda: F.col("_ltv"), *_AMOUNT, parts=("context",)),
    "ProductContributionPct": _core(lambda: _r6(divide(_sum("rev"), F.col("_all_products"), 0.0)), *_AMOUNT, parts=("context",)),
    "ProductVelocity": _core(lambda: _r6(divide(_s("qty"), _distinct_orders(), 0.0)), "qty", *_ORDERS),
    "SelectionSharePct": _core(lambda: _r6(divide(_sum("rev"), F.col("_selected"), 0.0)), *_AMOUNT, parts=("context",)),
    "TerritoryGrowthRank": Measure(lambda: F.col("_rank"), _any("now", "pm", "py"), _SHIFTED, ("context",), ("Year", "Quarter", "Month")),
}


def _fixed_year(year: int) -> Measure:
    """CALCULATE([Total Revenue], DateTable[Year] = year): the year's filter is
    replaced, those on other columns of the grain stay."""
    return Measure(lambda: _sum("rev", f"y{year}"), _any("now", "pm", "py"), _SHIFTED | {f"y{year}": _AMOUNT},
                   grains=("Year", "Quarter", "Month", "Date"))


def measure(name: str) -> Measure:
    if name in MEASURES:
        return MEASURES[name]
    if name.startswith("Revenue") and name[7:].isdigit():
        return _fixed_year(int(name[7:]))
    raise ValueError(f"not a measure: {name}")


# --- the base aggregate ------------------------------------------------------

class Base:
    """What the measures of one call need of the shared pass."""

    def __init__(self, g: DataFrame, keys: list[str], grain: Grain, wanted: list[Measure]):
        self.g, self.keys, self.grain = g, keys, grain
        self.parts = {p for m in wanted for p in m.parts}
        self.roles: dict[str, set[str]] = {}
        for m in wanted:
            for role, states in m.states.items():
                self.roles.setdefault(role, set()).update(states)
        used = set().union(*self.roles.values()) if self.roles else set()
        self.segmented = "CustomerSegment" in keys
        self.per_customer = bool(self.parts & {"customers", "before"}) or self.segmented
        self.per_order = self.per_customer or bool(used & set(_ORDERS)) or "days" in self.parts
        if noted := known(g, "calendar"):
            self.first_day, self.last_day = (F.lit(d) for d in noted)
        else:
            bounds = calendar_bounds(g)
            self.first_day, self.last_day = scalar(bounds, "start"), scalar(bounds, "end")
        self.latest = latest_order_date(g)
        self.mu = self.sd = None
        self.states: list[str] = sorted(used - set(_ORDERS))
        if self.segmented and "rev" not in self.states:
            self.states.append("rev")

    def unit(self, day: Column) -> Column:
        if not self.grain.columns:
            return F.lit(0)
        return F.unix_date(day) if self.grain is DATE else F.year(day) * 12 + F.month(day) - 1

    def orders(self, where) -> DataFrame:
        """Level 1: lines by order (and, in a second lane, by product)."""
        g = self.g
        if self.grain.columns:
            g = g.where(F.col("OrderDate").isNotNull())
        inside = F.lit(True) if where is None else F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        if not self.segmented:
            g, inside = (g if where is None else g.where(inside)), F.lit(True)
        if "spread" in self.parts:
            noted = known(self.g, "spread") if where is None else None
            chosen = self.g if where is None else self.g.where(inside)
            if noted:
                self.mu, self.sd = F.lit(noted[0]), F.lit(noted[1])
            else:
                one = chosen.agg(F.avg(REV).alias("mu"), F.stddev_pop(REV).alias("sd"))
                self.mu, self.sd = scalar(one, "mu"), scalar(one, "sd")
        states = line_states(self.mu, self.sd)
        own = [c for c in self.keys if c != "CustomerSegment"]
        lanes = [F.lit(0), F.lit(1)] if "products" in self.parts else [F.lit(0)]
        order_lane = F.col("_lane") == 0
        day = F.col("OrderDate")
        start = F.to_date(F.trunc(day, {12: "year", 3: "quarter", 1: "month"}.get(self.grain.months, "day"))) \
            if self.grain.months else day
        day_of_product = start if self.grain.columns else F.lit(None).cast("date")
        rows = g.select("*", inside.alias("_in"), (F.explode(F.array(*lanes)) if len(lanes) > 1 else lanes[0]).alias("_lane"))
        rows = rows.select(
            *own, "_in", "_lane", F.when(order_lane, day).otherwise(day_of_product).alias("_day"),
            (F.col("CustomerID") if self.segmented else F.when(order_lane, F.col("CustomerID")) if self.per_customer
             else F.lit(None).cast("long")).alias("_customer"),
            # Where an order's lines lie together, products keep the order: its key then groups both lanes in place.
            (F.lit(None).cast("long") if not self.per_order else F.col("SalesOrderID") if known(self.g, "by_order")
             else F.when(order_lane, F.col("SalesOrderID"))).alias("_order"),
            F.when(~order_lane, F.col("ProductName")).alias("_product"),
            (order_lane & (F.col("OrderStatus") == M.FULFILLED_STATUS)).alias("_ok"),
            *[(states[s] if s == "rev" else F.when(order_lane, states[s])).alias(s) for s in self.states])
        if not self.per_order:
            rows = rows.withColumn("_unit", self.unit(F.col("_day")))
            return rows.groupBy(*own, "_in", "_lane", "_unit", "_product").agg(
                *[F.sum(s).alias(s) for s in self.states], F.lit(0).alias("orders"), F.lit(0).alias("shipped"),
                F.lit(0).alias("blank"), F.lit(0).alias("blank_shipped"), F.max("_day").alias("_last"))
        rows = rows.groupBy(*own, "_in", "_lane", "_day", "_customer", "_order", "_product").agg(
            *[F.sum(s).alias(s) for s in self.states], F.max("_ok").alias("_ok"))
        real, lane = F.col("_order").isNotNull(), F.col("_lane") == 0

        def n(c: Column) -> Column:
            return F.when(c, 1).otherwise(0)
        rows = rows.select("*", n(real & lane).alias("orders"), n(real & lane & F.col("_ok")).alias("shipped"),
                           n(~real & lane).alias("blank"), n(~real & lane & F.col("_ok")).alias("blank_shipped"),
                           self.unit(F.col("_day")).alias("_unit"))
        return rows

    def units(self, where) -> DataFrame:
        """Level 2: (keys, lane, unit, customer or day, product) with states."""
        rows = self.orders(where)
        if not self.per_order:
            return rows.withColumn("_customer", F.lit(None).cast("long")).withColumn("_day", F.lit(None).cast("date"))
        own = [c for c in self.keys if c != "CustomerSegment"]
        if self.segmented:
            # An order with lines of several members counts once for its customer.
            one = Window.partitionBy("_customer", "_order", "_lane").orderBy(*own, "_day", "_in")
            rows = rows.withColumn("_one", F.when((F.row_number().over(one) == 1) & (F.col("orders") == 1), 1).otherwise(0))
        day = ["_day"] if "days" in self.parts else []
        out = rows.groupBy(*own, "_in", "_lane", "_unit", *day, *(["_customer"] if self.per_customer else []), "_product").agg(
            *[F.sum(s).alias(s) for s in (*self.states, *ORDER_STATES)], *[F.max(f).alias(f) for f in ORDER_FLAGS],
            F.max("_day").alias("_last"), *([F.sum("_one").alias("_one")] if self.segmented else []))
        if not day:
            out = out.withColumn("_day", F.lit(None).cast("date"))
        if not self.per_customer:
            out = out.withColumn("_customer", F.lit(None).cast("long"))
        if self.segmented:
            mine = Window.partitionBy("_customer")  # a customer's units and members
            lane = F.col("_lane") == 0
            days = day_diff(F.max(F.when(lane, F.col("_last"))).over(mine), self.latest)
            orders = F.sum("_one").over(mine) + F.max("blank").over(mine)
            spent = F.sum(F.when(lane, F.col("rev"))).over(mine)
            scores = M.rfm_scores(days, orders, spent)
            out = out.withColumn("CustomerSegment", M.dax_segment(*scores)).where("_in")
        return out

    def _spread(self) -> list[Column]:
        """(tag, period, customer, day, product, current, previous) of a row."""
        period = self.grain.period(F.col("_unit")) if self.grain.columns else F.lit(0)

        def role(tag: int, i: Column, customer=False, day=False, product=False, cur=0, prev=0) -> Column:
            nothing = F.lit(None)
            return F.struct(F.lit(tag).alias("tag"), i.cast("int").alias("i"),
                            (F.col("_customer") if customer else nothing.cast("long")).alias("c"),
                            (F.col("_day") if day else nothing.cast("date")).alias("d"),
                            (F.col("_product") if product else nothing.cast("string")).alias("p"),
                            F.lit(cur).alias("cur"), F.lit(prev).alias("prev"))
        unit = F.col("_unit") if self.grain.columns else F.lit(0)
        lines = [role(0, unit)]
        if "customers" in self.parts or "before" in self.parts:
            lines.append(role(1, period, customer=True, cur=1))
        if "before" in self.parts:
            after = self.grain.period(F.col("_unit") + 1)
            lines.append(F.when(F.col("_unit") + 1 <= F.col("_u1"), role(1, after, customer=True, prev=1)))
        if "days" in self.parts:
            lines.append(F.when(F.col("_day").isNotNull(), role(2, period, day=True)))
        product = role(3, period, product=True)
        return [F.when(F.col("_lane") == 0, x) for x in lines] + ([F.when(F.col("_lane") == 1, product)] if "products" in self.parts else [])

    def rolled(self, where) -> DataFrame:
        """Level 3: (keys, tag, i, product): tag 0 sums of a unit; 1 customers,
        2 days, 3 products of a period."""
        rows = self.units(where)
        sums = [F.sum(s).alias(s) for s in (*self.states, *ORDER_STATES)]
        flags = [F.max(f).alias(f) for f in (*ORDER_FLAGS, "_last")]
        if not self.parts & {"customers", "before", "days"}:  # a row goes to one place
            period = self.grain.period(F.col("_unit")) if self.grain.columns else F.lit(0)
            lane = F.col("_lane") == 0
            rows = rows.select(
                *self.keys, *self.states, *ORDER_STATES, *ORDER_FLAGS, "_last", F.when(lane, 0).otherwise(3).alias("tag"),
                F.when(lane, F.col("_unit")).otherwise(period).cast("int").alias("i"), F.when(~lane, F.col("_product")).alias("p"))
            none = [F.lit(None).cast("long").alias(c) for c in ("customers", "before", "kept", "again")]
            return rows.groupBy(*self.keys, "tag", "i", "p").agg(*sums, *flags).select(
                "*", *none, F.lit(None).cast("double").alias("per_day"))
        rows = rows.withColumn("_u1", self.unit(self.last_day))
        spread = F.filter(F.array(*self._spread()), lambda x: x.isNotNull())
        rows = rows.select("*", F.explode(spread).alias("_to"))
        rows = rows.select(*self.keys, *self.states, *ORDER_STATES, *ORDER_FLAGS, "_last", "_to.*")
        now = F.col("prev") == 0
        own = [F.sum(F.when(now, F.col(s))).alias(s) for s in (*self.states, *ORDER_STATES)]
        marks = [F.max(F.when(now, F.col(f))).alias(f) for f in (*ORDER_FLAGS, "_last")]
        rows = rows.groupBy(*self.keys, "tag", "i", "c", "d", "p").agg(*own, *marks, F.max("cur").alias("cur"), F.max("prev").alias("prev"))
        many = M._blank0(F.col("orders")) + M._blank0(F.col("blank"))

        def of(tag: int, value: Column) -> Column:
            return F.when(F.col("tag") == tag, value)
        return rows.groupBy(*self.keys, "tag", "i", "p").agg(
            *sums, *flags, F.sum(of(1, F.col("cur"))).alias("customers"), F.sum(of(1, F.col("prev"))).alias("before"),
            F.sum(of(1, F.col("cur") * F.col("prev"))).alias("kept"),
            F.sum(of(1, F.col("cur") * (many > 1).cast("int"))).alias("again"),
            F.avg(of(2, many)).alias("per_day"))

    def _running(self, rows: DataFrame) -> DataFrame:
        """Date grain with moving windows: each key's running sums of revenue,
        on every day from its first one on (days of its own: ``own``)."""
        by, last = Window.partitionBy(*self.keys, "tag", "p").orderBy("i"), F.col("_u1")
        total = [F.sum(F.coalesce(F.col(s), F.lit(0))).over(by).alias(f"run_{s}") for s in _AMOUNT]
        rows = rows.select("*", *total, F.lead("i").over(by).alias("_next"))
        span = F.when(F.col("tag") == 0, F.sequence("i", F.coalesce(F.col("_next") - 1, F.greatest("i", last)))).otherwise(F.array("i"))
        rows = rows.select("*", F.explode(span).alias("_at"))
        return rows.withColumn("own", F.col("_at") == F.col("i")).drop("i", "_next").withColumnRenamed("_at", "i")

    def _sent(self, moving: bool) -> Column:
        """The (role, period) pairs that a unit's sums go to."""
        g, i, first, last = self.grain, F.col("i"), F.col("_u0"), F.col("_u1")
        to: list[Column] = []

        def send_all(role: str, periods: Column, when: Column | None = None) -> None:
            at = F.transform(periods, lambda x: F.struct(F.lit(role).alias("role"), x.cast("int").alias("at")))
            to.append(at if when is None else F.filter(at, lambda _: when))

        def send(role: str, at: Column, when: Column | None = None) -> None:
            send_all(role, F.array(at), when)
        if not g.columns:
            send("now", F.lit(0))
        elif g is DATE:
            mine = F.col("own") if moving else F.lit(True)
            send("now", i, mine)
            for role, months in (("pm", 1), ("py", 12)):
                if role in self.roles:
                    send_all(role, self._days_back_to(i, months), mine)
            for k in (3, 6):
                if f"ma{k}" in self.roles:
                    send(f"ma{k}", i)
                    send_all(f"end{k}", self._days_back_to(i, k))
        else:
            send("now", g.period(i))
            for role, months in (("pm", 1), ("py", 12)):
                if role in self.roles:
                    send(role, g.period(i + months), i + months <= last)
            for k in (3, 6):
                if f"ma{k}" in self.roles:  # periods whose last month is among the next k
                    ends = F.filter(F.sequence(i, i + k - 1), lambda u: ((u + 1) % g.months == 0) & (u <= last))
                    send_all(f"ma{k}", F.transform(ends, lambda u: g.period(u)))
        for role in self.roles:
            if role[0] == "y" and role[1:].isdigit():
                year = int(role[1:])
                if g is DATE:
                    send(role, i, (F.year(F.date_from_unix_date(i)) == year) & (F.col("own") if moving else F.lit(True)))
                else:
                    years = F.sequence(F.floor(first / 12).cast("int"), F.floor(last / 12).cast("int"))
                    same = F.transform(years, lambda y: g.period(y * 12 + i % 12))
                    send_all(role, same, F.floor(i / 12) == year)
        return F.concat(*to)

    def _days_back_to(self, day: Column, months: int) -> Column:
        """The days whose date `months` earlier is `day` (months' ends meet)."""
        later = F.unix_date(F.add_months(F.date_from_unix_date(day), months))
        return F.filter(F.sequence(later, later + 3), lambda x: (
            F.unix_date(F.add_months(F.date_from_unix_date(x), -months)) == day) & (x <= F.col("_u1")))

    def cells(self, base: DataFrame) -> DataFrame:
        """Level 4: (keys, period), a column for each role and state."""
        moving = self.grain is DATE and bool(self.roles.keys() & {"ma3", "ma6"})
        # The calendar's first and last unit, as columns: lambdas take no subqueries.
        rows = base.select("*", self.unit(self.first_day).alias("_u0"), self.unit(self.last_day).alias("_u1"))
        rows = self._running(rows) if moving else rows
        unit = F.col("tag") == 0
        own = F.col("own") if moving else F.lit(True)
        here = F.array(F.struct(F.lit("").alias("role"), F.col("i").cast("int").alias("at")))
        rows = rows.select("*", F.explode(F.when(unit, self._sent(moving)).otherwise(here)).alias("_to"))
        out = []
        for role, states in self.roles.items():
            for s in sorted(states):
                running = moving and role in ("ma3", "ma6")
                value = F.when(F.col("_to.role") == role, F.col(f"run_{s}") if running else F.col(s))
                if running:
                    value = F.when(F.col("_to.role") == f"end{role[2:]}", -F.col(f"run_{s}")).otherwise(value)
                whole = F.max(value) if s in ORDER_FLAGS else F.sum(value)
                out.append((F.coalesce(whole, F.lit(0)) if s != "qty" else whole).alias(f"{role}_{s}"))
        counts = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("customers", "before", "kept", "again")]
        last = F.max(F.when((F.col("tag") == 0) & (F.col("_to.role") == "now") & own, F.col("_last"))).alias("last")
        cells = rows.groupBy(*self.keys, F.col("_to.at").alias("_period")).agg(*out, *counts, F.max("per_day").alias("per_day"), last)
        shown = self.grain.show(F.col("_period"))
        if "season" in self.parts:
            year = Window.partitionBy(*self.keys, F.floor(F.col("_period") / 12))  # twelve months
            cells = cells.withColumn("_year_mean", F.avg(F.when(_has_rows(), _sum("rev"))).over(year))
        return cells.select("*", *[c.alias(name) for name, c in shown.items()])


def evaluate(g: DataFrame, measures: list[str], by: list[str], where=None) -> DataFrame:
    """Any of the measures at the grain ``by``: attribute columns of the record,
    ``CustomerSegment``, and Year, Year and Quarter, Year and Month, or Date.

    ``where`` (a Column or SQL string) is the selection every measure sees.
    Rows are the keys where any of the measures has a row."""
    grain = grain_of(by)
    keys = [c for c in by if c not in grain.columns]
    names = list(dict.fromkeys(measures))
    wanted = [measure(m) for m in names]
    level = grain.columns[-1] if grain.columns else ""
    if wrong := [n for n, m in zip(names, wanted, strict=True) if level not in m.grains]:
        raise ValueError(f"not defined at the grain {by}: {wrong}")
    if "TerritoryGrowthRank" in names and "TerritoryName" not in keys:
        raise ValueError("TerritoryGrowthRank needs TerritoryName")
    base = Base(g, keys, grain, wanted)
    rolled = base.rolled(where)
    products = None
    if "products" in base.parts:  # read by two plans
        rolled = materialized(rolled, "measure-base")
        products = M.top_products(rolled.where("tag = 3").select(
            *keys, "i", F.col("p").alias("ProductName"), F.col("rev").alias("_rev")), [*keys, "i"])
        products = products.select(*keys, F.col("i").alias("_period"), F.col("ProductCount").alias("_products"),
                                   F.col("Top20ProductsRevenue").alias("_top"))
        rolled = rolled.where("tag <> 3")
    cells = base.cells(rolled)
    if products is not None:
        cells = M._keys_join(cells, products, [*keys, "_period"])
    if "context" in base.parts:
        cells = _contexts(materialized(cells, "measure-cells"), names, by)
    cells = cells.select("*", *[c.alias(n) for n, c in (
        ("_calendar_days", F.datediff(base.last_day, base.first_day) + 1), ("_latest", base.latest),
        ("_mu", base.mu), ("_sd", base.sd)) if c is not None])
    there = [m.there() for m in wanted]
    some = there[0]
    for t in there[1:]:
        some = some | t
    return cells.where(some).select(*by, *[F.when(t, m.value()).alias(n) for n, m, t in zip(names, wanted, there, strict=True)])


def _contexts(cells: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    wanted = {"CustomerLTV": ("_ltv", ROW.all_except(*M.LTV_KEPT)), "ProductContributionPct": ("_all_products", ROW.all_of("ProductName")),
              "SelectionSharePct": ("_selected", ROW.all_selected())}
    cells = calculate(cells, by, {out: ("now_rev", c) for n, (out, c) in wanted.items() if n in names})
    if "TerritoryGrowthRank" in names:
        cells = dense_rank_over(cells, by, "TerritoryName", _yoy(), "_rank")
    return cells
