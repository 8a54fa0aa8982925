"""Co-occurrence counting of item pairs inside baskets (orders).

The reference self-joins *lines* on the order id with ``p1 < p2``: an order
with L lines emits O(L²) rows, so one very large order would dominate a task.
Here lines are first aggregated to distinct items per basket (count, value
sum and non-null value count); pairs of distinct items are then joined on
the basket id and the line-pair statistics are rebuilt exactly:

* line pairs            = c1 · c2
* Σ (r1 + r2)           = R1 · n2 + R2 · n1      (over pairs with both values)
* pairs with values     = n1 · n2

Co-occurring item pairs are the report's own output groups, so they cannot be
skipped; what is bounded is the work per row.  A basket with k distinct items
produces k²/2 pairs from an input of only k rows.  Every basket is therefore cut
into cells: with S = ceil(k / cell_items) buckets ``hash(item) % S``, an item goes
to the cells of its own bucket, as left item with every right bucket and as right
item with every left one.  Every item pair meets in exactly one cell, and no cell
holds more than about ``2 * cell_items`` items.  An ordinary basket has S = 1.

A cell's items are gathered into two short lists and paired by explode, where a
self-join would shuffle them twice.

Baskets are measured by a count joined back, so that none is gathered to be
measured.  Where the rows of a basket lie in one task already (``together``), that
join would compute the items twice in each task: there a window counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import collated

CELL_ITEMS = 2000


def basket_items(df: DataFrame, basket: str, item_cols: list[str], value: str) -> DataFrame:
    """Distinct items per basket with line count, value sum and value count."""
    return df.groupBy(basket, *item_cols).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(value).alias("_r"), F.count(value).alias("_n"))


def item_pairs(items: DataFrame, basket: str, item_cols: list[str], order_col: str,
               suffixes=("1", "2"), cell_items: int = CELL_ITEMS, collation: str | None = None,
               together: bool = False) -> DataFrame:
    """Pairs of distinct items in the same basket with ``a.order_col < b.order_col``
    (by bytes, or under ``collation``).  ``together``: the items are partitioned
    by ``basket``.

    Output: ``<item>1``, ``<item>2`` columns plus ``pair_lines`` (c1·c2),
    ``pair_value_sum`` and ``pair_value_n``.
    """
    s1, s2 = suffixes
    columns = [*item_cols, "_c", "_r", "_n"]
    items = items.where(F.col(basket).isNotNull())
    cells_of = F.ceil(F.col("_k") / F.lit(cell_items)).cast("int")
    if together:
        # A window reads a basket's rows twice, from disk if they are many.
        counted = items.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(basket)))
    else:
        # Baskets of more than one cell: few, counted by partial aggregation.  The
        # count reads every column of the items, which lets Spark reuse their
        # shuffle instead of reading the lines twice.
        large = (items.groupBy(F.col(basket).alias("_sb"))
                 .agg(F.count(F.lit(1)).alias("_k"), F.max(F.hash("_c", "_r", "_n")).alias("_read"))
                 .where((F.col("_k") > cell_items) & F.col("_read").isNotNull()).select("_sb", "_k"))
        counted = items.join(large, F.col(basket) == F.col("_sb"), "left")
    celled = counted.select(basket, F.struct(*columns).alias("_item"),
                            F.when(F.col("_k") > cell_items, cells_of).otherwise(F.lit(1)).alias("_s"))
    own = F.pmod(F.xxhash64(*[F.col(f"_item.{c}") for c in item_cols]), F.col("_s")).cast("int")
    celled = celled.withColumn("_own", own)
    every = F.sequence(F.lit(0), F.col("_s") - 1)

    def cell(x, y, left, right):
        return F.struct(x.alias("x"), y.alias("y"), left.alias("left"), right.alias("right"))
    # The cell of the own bucket twice gets one row, for both sides.
    spots = F.concat(
        F.transform(every, lambda y: cell(F.col("_own"), y, F.lit(True), y == F.col("_own"))),
        F.transform(F.filter(every, lambda x: x != F.col("_own")),
                    lambda x: cell(x, F.col("_own"), F.lit(False), F.lit(True))))
    cells = (celled.select(basket, "_item", F.explode(spots).alias("_at")).groupBy(basket, "_at.x", "_at.y")
             .agg(F.collect_list(F.when(F.col("_at.left"), F.col("_item"))).alias("_a"),
                  F.collect_list(F.when(F.col("_at.right"), F.col("_item"))).alias("_b")))
    j = (cells.where((F.size("_a") > 0) & (F.size("_b") > 0)).select(F.explode("_a").alias("a"), "_b")
         .select("a", F.explode("_b").alias("b"))
         .where(collated(F.col(f"a.{order_col}"), collation) < collated(F.col(f"b.{order_col}"), collation)))
    j = j.select(*[F.col(f"a.{c}").alias(c + s1) for c in columns], *[F.col(f"b.{c}").alias(c + s2) for c in columns])
    n = F.col("_n" + s1) * F.col("_n" + s2)
    total = F.col("_r" + s1) * F.col("_n" + s2) + F.col("_r" + s2) * F.col("_n" + s1)
    return j.select(*[c + s1 for c in item_cols], *[c + s2 for c in item_cols],
                    (F.col("_c" + s1) * F.col("_c" + s2)).alias("pair_lines"),
                    F.when(n > 0, total).alias("pair_value_sum"), n.alias("pair_value_n"))
