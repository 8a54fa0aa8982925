"""B2-B7 — the human-resources cleaning queries (bare SELECTs in the
reference, one DataFrame function each).  ``as_of`` replaces GETDATE()."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import hour_boundaries, lit_date, month_boundaries, year_boundaries
from ...sources.catalog import Sources

# Code maps of the HR cleaning script.
MARITAL = {"M": "Married", "S": "Single"}
GENDER = {"M": "Male", "F": "Female"}
PAY_FREQUENCY = {1: "Monthly", 2: "Bi-Weekly"}
OPEN_END = _dt.date(9999, 12, 31)
HOURS_PER_WEEK, WEEKS_PER_YEAR = 40, 52


def _map(c, mapping, default=None):
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def department(src: Sources) -> DataFrame:
    """B2."""
    d = src["HumanResources.Department"]
    return d.select(F.col("departmentID"), F.trim("Name").alias("DeptName"),
                    F.trim("groupName").alias("Division"), "ModifiedDate")


def employee(src: Sources, as_of: _dt.date) -> DataFrame:
    """B3 — Age and tenure count year *boundaries* (T-SQL DATEDIFF(year))."""
    e = src["HumanResources.Employee"]
    now = lit_date(as_of)
    return e.select(
        "BusinessEntityID", "NationalIDNumber", "JobTitle",
        F.col("BirthDate").cast("date").alias("BirthDate"),
        F.col("HireDate").cast("date").alias("HireDate"),
        year_boundaries("BirthDate", now).alias("Age"),
        year_boundaries("HireDate", now).alias("TenureYears"),
        _map(F.col("MaritalStatus"), MARITAL, "N/A").alias("MaritalStatus"),
        _map(F.col("Gender"), GENDER, "N/A").alias("Gender"),
        F.when(F.col("SalariedFlag").cast("int") == 1, F.lit("Monthly Salary"))
         .otherwise(F.lit("Hourly Wage")).alias("PaymetType"),
        F.when(F.col("CurrentFlag").cast("int") == 1, F.lit("Active"))
         .otherwise(F.lit("Inactive")).alias("EmploymetStatus"),
    )


def department_history(src: Sources, as_of: _dt.date) -> DataFrame:
    """B4 — open assignments end on 9999-12-31 and run to ``as_of``."""
    h = src["HumanResources.EmployeeDepartmentHistory"]
    return h.select(
        "BusinessEntityID", "DepartmentID", "ShiftID",
        F.col("StartDate").cast("date").alias("StartDate"),
        F.coalesce(F.col("EndDate").cast("date"), lit_date(OPEN_END)).alias("EndDateClean"),
        F.when(F.col("EndDate").isNull(), F.lit("Active Assignment"))
         .otherwise(F.lit("Previous Assignment")).alias("AssignmentStatus"),
        month_boundaries(F.col("StartDate"), F.coalesce(F.col("EndDate").cast("date"), lit_date(as_of)))
        .alias("MonthsInRole"),
    )


def pay_history(src: Sources) -> DataFrame:
    """B5."""
    p = src["HumanResources.EmployeePayHistory"]
    rate = F.col("Rate")
    return p.select(
        "BusinessEntityID",
        F.col("RateChangeDate").cast("date").alias("RateChangeDate"),
        F.round(rate, 2).alias("HourlyRate"),
        F.round(rate * HOURS_PER_WEEK * WEEKS_PER_YEAR, 2).alias("EstimatedAnnualSalary"),
        _map(F.col("PayFrequency"), PAY_FREQUENCY).alias("PayFrequencyDesc"),
    )


def job_candidate(src: Sources) -> DataFrame:
    """B6."""
    j = src["HumanResources.JobCandidate"]
    return j.select("JobCandidateID", "BusinessEntityID",
                    F.when(F.col("Resume").isNotNull(), F.lit("Resume Uploaded"))
                     .otherwise(F.lit("No Resume")).alias("ApplicationStatus"),
                    "ModifiedDate")


def shift(src: Sources) -> DataFrame:
    """B7 — times as 'HH:mm:ss' strings; an overnight shift adds 24 hours.
    Times may come as text (with or without fractional seconds or a date), as
    timestamps, or as TIME values."""
    s = src["HumanResources.Shift"]

    def clock(name):
        found = F.regexp_extract(F.col(name).cast("string"), r"(\d{1,2}:\d{2}:\d{2})", 1)
        return F.lpad(F.when(found != "", found), 8, "0")
    start, end = clock("StartTime"), clock("EndTime")
    hours = hour_boundaries(start, end)
    return s.select("ShiftID", F.col("Name").alias("ShiftName"), start.alias("StartTime"),
                    end.alias("EndTime"),
                    F.when(end < start, hours + 24).otherwise(hours).alias("ShiftHours"))
