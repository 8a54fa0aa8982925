"""Scalar and aggregate semantics of T-SQL and DAX as built-in Column helpers."""

from .dax import distinctcount_blank, divide, switch_true, weeknum_us
from .tsql import (
    add_days_trunc,
    collated,
    count_distinct,
    day_diff,
    dec_avg,
    hour_boundaries,
    int_avg,
    isnull_typed,
    lit_date,
    money,
    month_boundaries,
    nullif0,
    round_half_up,
    safe_div,
    year_boundaries,
)

__all__ = [
    "add_days_trunc",
    "collated",
    "count_distinct",
    "day_diff",
    "dec_avg",
    "distinctcount_blank",
    "divide",
    "hour_boundaries",
    "int_avg",
    "isnull_typed",
    "lit_date",
    "money",
    "month_boundaries",
    "nullif0",
    "round_half_up",
    "safe_div",
    "switch_true",
    "weeknum_us",
    "year_boundaries",
]
