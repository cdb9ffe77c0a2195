"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_end(date: Column) -> Column:
    """Last day of the calendar quarter of a date."""
    return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def annual_available_date(year: Column, lag_months: int) -> Column:
    """First day of the month ``lag_months`` after December of the year."""
    return F.add_months(F.make_date(year, F.lit(12), F.lit(1)), lag_months)


def epoch_day(date: Column) -> Column:
    """Days since 1970, as a number that range frames can use."""
    return F.unix_date(date)
