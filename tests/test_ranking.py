"""Scalable global NTILE / running sum equal Spark's single-partition window."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerframe.operators.ranking import global_ntile, global_running_sum


def _check(spark, n, ties):
    rnd = random.Random(n)
    rows = [(i, rnd.randint(0, 3) if ties else rnd.randint(0, 10 ** 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, v int")
    order = [F.col("v").desc(), F.col("id").asc()]
    got = {r.id: r.t for r in global_ntile(df, 5, order, "t", num_partitions=7).collect()}
    assert got == {r.id: r.t for r in global_ntile(df, 5, order, "t").collect()}
    exp = {r.id: r.t for r in df.select("id", F.ntile(5).over(Window.orderBy(*order)).alias("t")).collect()}
    assert got == exp
    sizes = {}
    for t in got.values():
        sizes[t] = sizes.get(t, 0) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_ntile_matches_window(spark):
    for n, ties in [(3, False), (7, True), (1003, True), (2000, False)]:
        _check(spark, n, ties)


def test_ntile_plan_has_no_single_partition_sort_of_rows(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    out = global_ntile(df, 5, [F.col("v"), F.col("id")], "t", num_partitions=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the only single-partition step is over the per-range counts
    assert "RangePartitioning" not in plan  # ranges were written
    assert out.count() == 100


def test_running_sum_matches_window(spark):
    rows = [(i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int")
    order = [F.col("v").desc(), F.col("id").asc()]
    got = {r.id: r.c for r in global_running_sum(df, order, "v", "c", num_partitions=5).collect()}
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    exp = {r.id: r.c for r in df.select("id", F.sum("v").over(w).alias("c")).collect()}
    assert got == exp


def test_hot_basket_split_pairs_equal_plain_pairs(spark):
    from ledgerframe.operators.pairs import basket_items, item_pairs
    rnd = random.Random(7)
    rows = []
    for basket in range(40):
        k = 1 + (basket % 9) * 3                      # some baskets of many cells
        for _ in range(k):
            rows.append((basket, f"p{rnd.randint(0, 30)}", rnd.choice(["A", "B"]), float(rnd.randint(1, 9))))
    df = spark.createDataFrame(rows, "b int, p string, c string, v double")
    items = basket_items(df, "b", ["p", "c"], "v")
    cols = ["p1", "c1", "p2", "c2", "pair_lines", "pair_value_sum", "pair_value_n"]
    plain = sorted(map(tuple, item_pairs(items, "b", ["p", "c"], "p", cell_items=10 ** 9).select(*cols).collect()))
    split = sorted(map(tuple, item_pairs(items, "b", ["p", "c"], "p", cell_items=3).select(*cols).collect()))
    assert plain == split and len(plain) > 100


def test_pairs_of_baskets_that_lie_together_equal_plain_pairs(spark):
    """Counted by a window: the same pairs, small and hot baskets, null baskets and items, and one pass of the lines."""
    from ledgerframe.operators.pairs import basket_items, item_pairs
    rnd = random.Random(11)
    rows = [(b, rnd.choice([None, *(f"p{i}" for i in range(30))]), rnd.choice(["A", None]), rnd.choice([None, 1.0, 4.0]))
            for b in [*range(20), None] for _ in range(1 + ((b or 0) % 7) * 4)]
    df = spark.createDataFrame(rows, "b int, p string, c string, v double").repartition(3, "b")
    items = basket_items(df, "b", ["p", "c"], "v")

    def pairs(**how):
        return item_pairs(items, "b", ["p", "c"], "p", **how)
    plain = sorted(map(str, pairs(cell_items=10 ** 9).collect()))
    assert len(plain) > 100
    for cells in (1, 3, 10 ** 9):
        assert sorted(map(str, pairs(cell_items=cells, together=True).collect())) == plain
        assert sorted(map(str, pairs(cell_items=cells).collect())) == plain
    plan = pairs(together=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_multiple_ntiles(spark):
    from ledgerframe.operators.ranking import global_ntiles
    df = spark.createDataFrame([(i, (i * 7) % 5, (i * 3) % 11) for i in range(300)], "id int, a int, b int")
    specs = [(5, [F.col("a"), F.col("id")], "ta"), (4, [F.col("b").desc(), F.col("id")], "tb")]
    plain = df.select("id", *[F.ntile(k).over(Window.orderBy(*o)).alias(c) for k, o, c in specs])
    got = global_ntiles(df, specs, num_partitions=3).select("id", "ta", "tb")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_unset_checkpoint_folder_is_a_clear_error():
    import pytest

    from ledgerframe.session import ensure_checkpoint_dir

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None)})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Unset())
