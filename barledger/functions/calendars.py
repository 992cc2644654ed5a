"""Date spines and date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def calendar_days(spans: DataFrame, first: str, last: str, name: str = "day", weekdays_only: bool = False) -> DataFrame:
    """Explode each row into the days from ``first`` to ``last``, optionally Monday to Friday."""
    days = spans.where(F.col(first) <= F.col(last)).withColumn(
        name, F.explode(F.expr(f"sequence({first}, {last}, interval 1 day)"))
    )
    return days.where(F.weekday(name) < 5) if weekdays_only else days


def last_business_day(day: Column) -> Column:
    """The day itself, or the Friday before a weekend."""
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def month_before(day: Column) -> Column:
    return F.add_months(day, -1)
