"""Filter context as data: what CALCULATE does to a row's filters.

A measure shown at a grain is evaluated once for each row of the grain; the
row filters every grain column to its own member (context transition).  A
`Context` says what a modifier makes of these filters:

* ``all_of(c)``             ALL(c): the filter on c goes
* ``all_except(c, ...)``    ALLEXCEPT(t, c, ...): every filter but these goes
* ``all_selected()``        ALLSELECTED(t): the rows' filters go, the selection stays
* ``replaced(c, p)``        CALCULATE(m, c = x): p instead of the filter on c
* ``narrowed(c, p)``        KEEPFILTERS: p besides it

They chain, as nested CALCULATEs do.  `calculate` compiles contexts over *cells*
(one row per member of the grain, with additive states): contexts that keep the
same columns become one aggregation with conditional sums, joined back on those
columns.  The cells are a roll-up of the fact, so no context reads the fact.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import join_group_stats


@dataclass(frozen=True)
class Context:
    """``only``: the columns whose filters stay (None: all); ``gone``: those
    whose filters went; ``tests``: predicates (SQL) on the grain's columns."""

    only: frozenset[str] | None = None
    gone: frozenset[str] = frozenset()
    tests: tuple[tuple[str, str], ...] = ()

    def all_of(self, *columns: str) -> Context:
        return Context(self.only, self.gone | set(columns), tuple(t for t in self.tests if t[0] not in columns))

    def all_except(self, *columns: str) -> Context:
        only = frozenset(columns) if self.only is None else self.only & set(columns)
        return Context(only, self.gone, tuple(t for t in self.tests if t[0] in columns))

    def all_selected(self) -> Context:
        return Context(frozenset())

    def replaced(self, column: str, predicate: str) -> Context:
        return Context(self.only, self.gone | {column}, (*(t for t in self.tests if t[0] != column), (column, predicate)))

    def narrowed(self, column: str, predicate: str) -> Context:
        return Context(self.only, self.gone, (*self.tests, (column, predicate)))

    def kept(self, by: list[str]) -> list[str]:
        """The grain's columns that still filter."""
        return [c for c in by if c not in self.gone and (self.only is None or c in self.only)]

    def test(self) -> Column | None:
        out = None
        for _, p in self.tests:
            out = F.expr(p) if out is None else out & F.expr(p)
        return out


ROW = Context()


def calculate(cells: DataFrame, by: list[str], wanted: dict[str, tuple[str, Context]]) -> DataFrame:
    """Append ``name`` = the sum of an additive state in a context, for each
    ``name: (state, context)``."""
    groups: dict[tuple[str, ...], list[Column]] = defaultdict(list)
    for name, (state, context) in wanted.items():
        test = context.test()
        value = F.col(state) if test is None else F.when(test, F.col(state))
        groups[tuple(context.kept(by))].append(F.sum(value).alias(name))
    for kept, sums in groups.items():
        cells = join_group_stats(cells, list(kept), sums)
    return cells


def dense_rank_over(cells: DataFrame, by: list[str], over: str, value: Column, name: str) -> DataFrame:
    """Append ``name`` = RANKX(ALL(over), value, , DESC, DENSE).

    ``value`` is that of members with a cell; a member that has none in a row's
    context counts with 0, the value of a growth between two BLANKs."""
    rest = [c for c in by if c != over]
    members = cells.agg(F.count_distinct(over).alias("n"), F.max(F.col(over).isNull().cast("int")).alias("blank"))
    total = members.select((F.col("n") + F.col("blank")).alias("t")).scalar()
    group = Window.partitionBy(*rest)  # the members of one dimension
    valued = cells.withColumn("_v", value)
    rank = F.dense_rank().over(group.orderBy(F.col("_v").desc()))
    absent = (F.count(F.lit(1)).over(group) < total) & (F.max((F.col("_v") == 0).cast("int")).over(group) == 0)
    return valued.withColumn(name, rank + F.when(absent & (F.col("_v") < 0), 1).otherwise(0)).drop("_v")
