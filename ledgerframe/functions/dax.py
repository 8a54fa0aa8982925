"""DAX scalar/aggregate semantics as Spark Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tsql import ColumnOrName, _c


def divide(a: ColumnOrName, b: ColumnOrName, alternate=None) -> Column:
    """DAX ``DIVIDE(a, b[, alternate])``.

    A zero or BLANK denominator gives ``alternate`` (BLANK when omitted);
    the division itself is done in DOUBLE like the DAX engine.
    """
    num, den = _c(a).cast("double"), _c(b).cast("double")
    alt = alternate if isinstance(alternate, Column) else F.lit(alternate).cast("double")
    return F.when(den.isNull() | (den == 0), alt).otherwise(num / den)


def distinctcount_blank(x: ColumnOrName) -> Column:
    """DAX ``DISTINCTCOUNT``: like COUNT(DISTINCT) but BLANK counts as a value."""
    c = _c(x)
    return F.countDistinct(c) + F.max(c.isNull().cast("int"))


def weeknum_us(d: ColumnOrName) -> Column:
    """DAX/Excel ``WEEKNUM(d)`` (return type 1).

    Week 1 is the week containing 1 January, weeks start on Sunday.  This is
    *not* ISO ``weekofyear``.
    """
    c = _c(d)
    jan1 = F.make_date(F.year(c), F.lit(1), F.lit(1))
    return (F.floor((F.dayofyear(c) + F.dayofweek(jan1) - 2) / 7) + 1).cast("int")


def switch_true(*branches, default=None) -> Column:
    """DAX ``SWITCH(TRUE(), cond1, v1, cond2, v2, ..., default)``."""
    out = None
    for cond, val in branches:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(d) if default is not None else out
