"""T-SQL scalar semantics expressed as built-in Spark Column expressions.

Everything here is a pure ``Column -> Column`` helper that stays inside
whole-stage codegen (no Python UDF).  The helpers exist only where Spark's
built-in behaviour differs from SQL Server's:

* DATEDIFF(month/year/hour) counts *boundaries crossed*, Spark counts
  complete units;
* AVG over an integer column truncates to an integer in T-SQL;
* ISNULL(a, b) takes the type of ``a``;
* NULLIF(x, 0) guards (Spark's ANSI mode raises on division by zero);
* ROUND is half away from zero on exact decimals.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_date(d: _dt.date | str) -> Column:
    """A DATE literal (``as_of`` arguments are plain dates); None is today's
    date at run time (GETDATE)."""
    if d is None:
        return F.current_date()
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d).cast("date")


def month_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """T-SQL ``DATEDIFF(month, start, end)``: month boundaries crossed."""
    s, e = _c(start), _c(end)
    return (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))


def year_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """T-SQL ``DATEDIFF(year, start, end)``: year boundaries crossed."""
    return F.year(_c(end)) - F.year(_c(start))


def hour_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """T-SQL ``DATEDIFF(hour, start, end)`` for two times of one day.

    Works on ``HH:mm:ss`` strings or timestamps.
    """
    s, e = _c(start), _c(end)
    return _hour_of(e) - _hour_of(s)


def _hour_of(x: Column) -> Column:
    # 'HH:mm:ss' (the portable time(0) contract) or 'yyyy-MM-dd HH:mm:ss':
    # the hour is the last two characters before the first ':'.
    head = F.split(x.cast("string"), ":").getItem(0)
    return F.trim(F.substring(head, -2, 2)).cast("int")


def day_diff(start: ColumnOrName, end: ColumnOrName) -> Column:
    """T-SQL ``DATEDIFF(day, start, end)`` (note the argument order)."""
    return F.datediff(_c(end).cast("date"), _c(start).cast("date"))


def add_days_trunc(days: ColumnOrName, d: ColumnOrName) -> Column:
    """T-SQL ``DATEADD(day, <float>, d)``: the fraction is truncated."""
    return F.date_add(_c(d), _c(days).cast("int"))


def int_avg(x: ColumnOrName) -> Column:
    """T-SQL ``AVG(<int column>)``: integer result, truncated toward zero.

    Both ``sum`` and ``count`` are partial-aggregated, so this stays a plain
    two-phase hash aggregate.
    """
    c = _c(x)
    s = F.sum(c.cast("bigint"))
    n = F.count(c)
    # ``div`` is Spark's integral division (truncates toward zero, exact on
    # longs), the same rule T-SQL applies to int / int.
    return F.when(n > 0, F.call_function("div", s, n).cast("int"))


def collated(x: ColumnOrName, collation: str | None) -> Column:
    """The string under a collation for comparisons (e.g. ``UTF8_LCASE``: case
    ignored); None compares by bytes."""
    return F.collate(_c(x), collation) if collation else _c(x)


def nullif0(x: ColumnOrName) -> Column:
    """``NULLIF(x, 0)``."""
    c = _c(x)
    return F.when(c != 0, c)


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``a / NULLIF(b, 0)`` evaluated in DOUBLE.

    The reference divides NUMERIC operands in most places (scale 6,
    truncated) and FLOAT where it casts; DOUBLE is used for both, a deviation
    that README lists (it can differ in the seventh decimal)."""
    return _c(a).cast("double") / nullif0(_c(b).cast("double"))


def isnull_typed(a: ColumnOrName, b, data_type: str) -> Column:
    """T-SQL ``ISNULL(a, b)``: the result has the type of ``a``, so the
    replacement is cast to it (``data_type`` names it: a Column knows no type
    before it is resolved)."""
    rep = b if isinstance(b, Column) else F.lit(b)
    return F.coalesce(_c(a), rep.cast(data_type))


def round_half_up(x: ColumnOrName, n: int = 2) -> Column:
    """``ROUND(x, n)`` returning DOUBLE, half away from zero.

    The value is first snapped to 10 decimals (exact DECIMAL), then rounded
    exactly, so last-bit noise from floating aggregation order (which
    differs between partitionings) cannot move the rounded result.
    """
    return F.round(_c(x).cast("decimal(38,10)"), n).cast("double")


def money(x: ColumnOrName) -> Column:
    """Canonical DECIMAL(38,6) money type (T-SQL ``numeric(38,6)`` LineTotal)."""
    return _c(x).cast("decimal(38,6)")


def dec_avg(x: ColumnOrName) -> Column:
    """Exact mean of a DECIMAL column (scale <= 6) at 16 decimals.

    Spark's ``avg(decimal(p, s))`` rounds at scale s+4; a later ROUND to 6
    decimals of a scale-4 column would then round twice.  Summing exactly
    and dividing once keeps a single rounding.
    """
    c = _c(x)
    return F.sum(c).cast("decimal(28,6)") / F.count(c).cast("decimal(20,0)")


def count_distinct(x: ColumnOrName, approx: bool = False, rsd: float = 0.01) -> Column:
    """``COUNT(DISTINCT x)``; ``approx=True`` swaps in HyperLogLog++
    (``approx_count_distinct``, relative error ``rsd``), which aggregates
    map-side into fixed-size sketches instead of shuffling every distinct
    value — an opt-in for very large inputs, never the default."""
    c = _c(x)
    return F.approx_count_distinct(c, rsd) if approx else F.countDistinct(c)
