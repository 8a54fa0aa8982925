"""Date dimension (the dashboard's DateTable, E0-E9).

``CALENDARAUTO()`` spans 1 January of the earliest year to 31 December of
the latest year over the model's date columns (OrderDate and ShipDate of the
golden record).  The bounds are one global aggregate (a scalar); the day
rows are generated by ``sequence`` + ``explode`` — their number is bounded
by the calendar span, not by data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import weeknum_us
from ..operators.stats import known

DATE_COLUMNS = ("OrderDate", "ShipDate")

CALENDAR_COLUMNS = ["Date", "Year", "YearMonth", "YearQuarter", "Quarter", "QuarterName", "Month",
                    "MonthName", "MonthShort", "MonthYear", "WeekOfYear", "DayOfWeek", "DayName",
                    "DayShort", "IsWeekend", "FiscalYear", "DayOfMonth", "IsLastDayOfMonth"]


def calendar_bounds(g: DataFrame, date_cols=DATE_COLUMNS) -> DataFrame:
    """One row: first and last calendar day (whole years)."""
    noted = known(g, "calendar") if tuple(date_cols) == DATE_COLUMNS else None
    if noted:
        return g.sparkSession.range(1).select(F.lit(noted[0]).alias("start"), F.lit(noted[1]).alias("end"))
    lo = F.least(*[F.min(c) for c in date_cols])
    hi = F.greatest(*[F.max(c) for c in date_cols])
    return g.agg(F.make_date(F.year(lo), F.lit(1), F.lit(1)).alias("start"),
                 F.make_date(F.year(hi), F.lit(12), F.lit(31)).alias("end"))


def date_table(g: DataFrame, date_cols=DATE_COLUMNS) -> DataFrame:
    days = calendar_bounds(g, date_cols).select(
        F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("Date"))
    d = F.col("Date")
    q = F.quarter(d)
    dow = F.dayofweek(d)  # 1 = Sunday, as WEEKDAY(d) with return type 1
    return days.select(
        d,
        F.year(d).alias("Year"),
        F.date_format(d, "yyyy-MM").alias("YearMonth"),
        F.concat(F.lit("Q"), q.cast("string"), F.lit(" "), F.year(d).cast("string")).alias("YearQuarter"),
        q.alias("Quarter"),
        F.concat(F.lit("Q"), q.cast("string")).alias("QuarterName"),
        F.month(d).alias("Month"),
        F.date_format(d, "MMMM").alias("MonthName"),
        F.date_format(d, "MMM").alias("MonthShort"),
        F.date_format(d, "MMM yyyy").alias("MonthYear"),
        weeknum_us(d).alias("WeekOfYear"),
        dow.alias("DayOfWeek"),
        F.date_format(d, "EEEE").alias("DayName"),
        F.date_format(d, "EEE").alias("DayShort"),
        dow.isin(1, 7).alias("IsWeekend"),
        F.when(F.month(d) >= 7, F.year(d) + 1).otherwise(F.year(d)).alias("FiscalYear"),
        F.dayofmonth(d).alias("DayOfMonth"),
        (d == F.last_day(d)).alias("IsLastDayOfMonth"),
    )
