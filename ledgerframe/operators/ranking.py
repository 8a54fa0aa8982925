"""Global row numbers, NTILE and running sums over a total order without a
single-partition sort.

``ntile(k) OVER (ORDER BY ...)`` with no PARTITION BY plans as
``Exchange SinglePartition`` in Spark: the whole input is sorted by one task.
Here instead, for every input size alike:

1. ``repartitionByRange(order)`` + ``sortWithinPartitions(order)``: the total
   order is split into sorted ranges (the order includes the caller's
   tiebreak, so even a heavily tied key splits);
2. the ranges are written to the shared checkpoint folder together with each
   row's range and position, so what is counted and what is ranked are the
   same rows (a recomputation after executor loss cannot move one);
3. per-range row counts (one row per range) give each range's offset: a
   running sum over the ranges, broadcast back — bounded by their number;
4. the row number is offset + position.

The only single-partition step is the running sum over the range counts.
Writing the ranges is a job that runs while the plan is being built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

_ID_BITS = 33  # monotonically_increasing_id: partition id in the upper bits


def _ranged(df: DataFrame, order: list[Column], num_partitions: int | None) -> DataFrame:
    """``df`` in sorted ranges, written with ``_rng`` and ``_pos`` (0-based)."""
    parts = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    tagged = parts.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    saved = materialized(tagged, "ranges")
    rng = F.shiftright("_id", _ID_BITS)
    return saved.select(*df.columns, rng.alias("_rng"), (F.col("_id") - F.shiftleft(rng, _ID_BITS)).alias("_pos"))


def _offsets(per_range: DataFrame, value: str) -> DataFrame:
    """(_rng, _off, _all): the sum of ``value`` before each range, and in all."""
    run = Window.orderBy("_rng")
    return per_range.select(
        "_rng", F.coalesce(F.sum(value).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum(value).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))


def global_row_number(df: DataFrame, order: list[Column], out: str = "_rn",
                      num_partitions: int | None = None) -> DataFrame:
    """Append ``out`` = ROW_NUMBER() OVER (ORDER BY order) (1-based, bigint).

    ``order`` must be a total order (append tiebreak columns) for the result
    to be deterministic.  Also appends ``_rn_total`` (row count).
    """
    ranged = _ranged(df, order, num_partitions)
    offsets = _offsets(ranged.groupBy("_rng").agg(F.count(F.lit(1)).alias("_cnt")), "_cnt")
    # offsets has one row per range: broadcast
    res = ranged.join(F.broadcast(offsets), "_rng")
    return res.select(*df.columns, (F.col("_off") + F.col("_pos") + 1).alias(out), F.col("_all").alias("_rn_total"))


def ntile_from_row_number(rn: Column, total: Column, k: int) -> Column:
    """Standard NTILE(k) bucket for 1-based row number ``rn`` of ``total`` rows:
    the first ``total % k`` buckets hold one extra row."""
    b = F.call_function("div", total, F.lit(k))   # base bucket size
    r = total % k                                  # buckets with b + 1 rows
    big = r * (b + 1)
    first = F.call_function("div", rn - 1, b + 1) + 1
    rest = r + F.call_function("div", rn - big - 1, F.greatest(b, F.lit(1))) + 1
    return F.when(rn <= big, first).otherwise(rest).cast("int")


def global_ntile(df: DataFrame, k: int, order: list[Column], out: str,
                 num_partitions: int | None = None) -> DataFrame:
    """Append ``out`` = NTILE(k) OVER (ORDER BY order)."""
    ranked = global_row_number(df, order, "_rn", num_partitions)
    return ranked.select(*df.columns,
                         ntile_from_row_number(F.col("_rn"), F.col("_rn_total"), k).alias(out))


def global_ntiles(df: DataFrame, specs: list[tuple[int, list[Column], str]],
                  num_partitions: int | None = None) -> DataFrame:
    """Several NTILEs over different total orders: ``specs`` is a list of
    (k, order, out).  ``df`` is written first: finding the ranges reads it
    once more, and only the written rows are read again."""
    df = materialized(df, "ntile-input")
    for k, order, out in specs:
        df = global_ntile(df, k, order, out, num_partitions)
    return df


def global_running_sum(df: DataFrame, order: list[Column], value: str, out: str,
                       num_partitions: int | None = None) -> DataFrame:
    """Append ``out`` = SUM(value) OVER (ORDER BY order ROWS UNBOUNDED PRECEDING)
    and ``out + '_total'``: the running sum inside a range plus the range's
    offset."""
    ranged = _ranged(df, order, num_partitions)
    offsets = _offsets(ranged.groupBy("_rng").agg(F.sum(value).alias("_s")), "_s")
    local = Window.partitionBy("_rng").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    res = ranged.join(F.broadcast(offsets), "_rng")
    return res.select(*df.columns, (F.col("_off") + F.sum(value).over(local)).alias(out),
                      F.col("_all").alias(out + "_total"))
