"""Whole-partition statistics without whole-partition windows.

``SUM(x) OVER (PARTITION BY k)`` sends every row of a partition key to one
task.  When the number of rows per key is not bounded (a category may hold a
third of all products), compute the statistic with a partial aggregation
(``groupBy(k).agg``) and join it back on ``k`` instead: the aggregate side has
one row per key, AQE broadcasts it when its measured size is small and
otherwise sort-merge joins it, splitting skewed partitions.

Windows with an ORDER BY over *aggregated periods* (months, years) stay
windows: their partitions are bounded by the calendar.
"""

from __future__ import annotations

from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# One-row statistics of materialised records, by DataFrame: plans put them in
# as literals instead of scanning the record for them again.
_KNOWN: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def remember(df: DataFrame, **values) -> DataFrame:
    """Note statistics of ``df``; only for contents that no longer change."""
    _KNOWN[df] = values
    return df


def known(df: DataFrame, name: str):
    """A statistic noted for ``df`` itself, or None."""
    return _KNOWN.get(df, {}).get(name)


def join_group_stats(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Append per-``keys`` aggregates to every row (null keys group together,
    as in a window partition)."""
    if not keys:
        return with_scalars(df, df.agg(*aggs))
    stats = df.groupBy(*keys).agg(*aggs)
    ren = {k: f"__k_{i}" for i, k in enumerate(keys)}
    stats = stats.select(*[F.col(k).alias(ren[k]) for k in keys],
                         *[c for c in stats.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(stats[ren[k]]) for k in keys])
    return df.join(stats, cond, "left").drop(*ren.values())


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate (global statistics) to every
    row as scalar subqueries: Spark evaluates the aggregate once (identical
    subqueries are merged) and inlines the values — no join at all."""
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def scalar(one_row: DataFrame, col: str) -> Column:
    """One value of a one-row aggregate as a scalar-subquery Column."""
    return one_row.select(col).scalar()
