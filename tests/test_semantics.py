"""T-SQL / DAX helper semantics."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerframe.functions import (dec_avg, distinctcount_blank, divide, hour_boundaries, int_avg,
                                   month_boundaries, round_half_up, weeknum_us, year_boundaries)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_boundary_date_diffs(spark):
    r = one(spark,
            month_boundaries(F.lit(dt.date(2020, 1, 31)), F.lit(dt.date(2020, 2, 1))).alias("m"),
            year_boundaries(F.lit(dt.date(2019, 12, 31)), F.lit(dt.date(2020, 1, 1))).alias("y"),
            hour_boundaries(F.lit("23:00:00"), F.lit("07:00:00")).alias("h"))
    assert (r.m, r.y, r.h) == (1, 1, -16)


def test_int_avg_truncates(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    assert df.agg(int_avg("x").alias("a")).first().a == 1


def test_weeknum_us_not_iso(spark):
    # 2023-01-01 is a Sunday: WEEKNUM gives 1 (ISO weekofyear gives 52)
    r = one(spark, weeknum_us(F.lit(dt.date(2023, 1, 1))).alias("a"),
            weeknum_us(F.lit(dt.date(2023, 1, 7))).alias("b"),
            weeknum_us(F.lit(dt.date(2023, 1, 8))).alias("c"),
            weeknum_us(F.lit(dt.date(2022, 1, 1))).alias("d"),
            weeknum_us(F.lit(dt.date(2022, 1, 2))).alias("e"))
    assert (r.a, r.b, r.c, r.d, r.e) == (1, 1, 2, 1, 2)


def test_divide_blank_and_zero(spark):
    r = one(spark, divide(F.lit(5), F.lit(0), 0.0).alias("z"), divide(F.lit(5), F.lit(None), 0.0).alias("b"),
            divide(F.lit(None), F.lit(5), 0.0).alias("n"), divide(F.lit(1), F.lit(4)).alias("q"))
    assert (r.z, r.b, r.n, r.q) == (0.0, 0.0, None, 0.25)


def test_distinctcount_counts_blank(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    assert df.agg(distinctcount_blank("x").alias("n")).first().n == 3


def test_round_half_up_and_exact_avg(spark):
    r = one(spark, round_half_up(F.lit(2.675), 2).alias("a"), round_half_up(F.lit(-2.5), 0).alias("b"))
    assert (r.a, r.b) == (2.68, -3.0)
    df = spark.createDataFrame([(Decimal("1.0001"),), (Decimal("2.0002"),)], "x decimal(19,4)")
    assert df.agg(dec_avg("x").alias("a")).first().a == Decimal("1.5001500000000000")


def test_remaining_helpers(spark):
    from ledgerframe.functions import add_days_trunc, day_diff, isnull_typed, nullif0, safe_div, switch_true
    r = one(spark,
            day_diff(F.lit(dt.date(2020, 1, 31)), F.lit(dt.date(2020, 3, 1))).alias("dd"),
            add_days_trunc(F.lit(2.9), F.lit(dt.date(2020, 1, 1))).alias("ad"),
            isnull_typed(F.lit(None).cast("string"), "N/A", "string").alias("isn"),
            nullif0(F.lit(0)).alias("nz"),
            safe_div(F.lit(1), F.lit(0)).alias("sd0"), safe_div(F.lit(3), F.lit(2)).alias("sd"),
            switch_true((F.lit(1) > 2, "a"), (F.lit(2) > 1, "b"), default="c").alias("sw"))
    assert (r.dd, r.ad, r.isn, r.nz, r.sd0, r.sd, r.sw) == (30, dt.date(2020, 1, 3), "N/A", None, None, 1.5, "b")
