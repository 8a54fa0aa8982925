"""Several distinct counts in one aggregation, without Spark's Expand.

``COUNT(DISTINCT a), COUNT(DISTINCT b), COUNT(DISTINCT c)`` in one GROUP BY makes
Spark copy every line once per distinct column (and once more for the sums).
Where one column determines the next (an order has one customer), a roll-up
through levels needs no copy: lines are grouped by (keys, order, customer), those
rows by (keys, customer), those by keys.  At each level a distinct count is a
count of rows, and sums, minima and maxima merge, partially aggregated each time.

A column outside the chain (the product) takes a second lane: one copy of the
line that carries only its own value, so that it folds to (keys, product).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def distinct_by_levels(df: DataFrame, keys: list[str], chain: dict[str, str], states: dict[str, tuple[str, Column]],
                       apart: tuple[str, str] | None = None) -> DataFrame:
    """One row per ``keys`` with ``states`` (name -> ("sum" | "min" | "max", value))
    and distinct counts, nulls apart.

    ``chain``: output name -> column, each non-null value of a column having one
    value of every later one.  ``apart``: (output name, column) outside the chain.
    """
    lane = F.col("_lane")
    first = lane == 0
    lanes = F.explode(F.array(F.lit(0), F.lit(1))) if apart else F.lit(0)
    marks = {f"_l{i}": F.when(first, F.col(c)) if apart else F.col(c) for i, c in enumerate(chain.values())}
    side = {"_apart": F.when(~first, F.col(apart[1]))} if apart else {}
    rows = df.select("*", lanes.alias("_lane")).select(
        *keys, "_lane", *[c.alias(n) for n, c in {**marks, **side}.items()],
        *[(F.when(first, v) if apart else v).alias(n) for n, (_, v) in states.items()])

    def merged() -> list[Column]:
        return [_MERGE[how](n).alias(n) for n, (how, _) in states.items()]
    names, levels = list(chain), list(marks)
    rows = rows.groupBy(*keys, "_lane", *levels, *side).agg(*merged())
    for i, (name, level) in enumerate(zip(names, levels, strict=True)):
        done = [F.sum(n).alias(n) for n in names[:i]]
        one = F.sum((first & F.col(level).isNotNull()).cast("bigint")).alias(name)
        if i + 1 < len(levels):
            rows = rows.groupBy(*keys, "_lane", *levels[i + 1:], *side).agg(*merged(), *done, one)
        else:
            more = [F.sum((~first & F.col("_apart").isNotNull()).cast("bigint")).alias(apart[0])] if apart else []
            rows = rows.groupBy(*keys).agg(*merged(), *done, one, *more)
    return rows
