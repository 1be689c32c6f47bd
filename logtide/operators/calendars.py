"""Calendar tables and the zero rows they add to reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import calendars as cal
from logtide.functions.calendars import GRAIN_COLUMNS, DateLike


def log_months(log: DataFrame) -> tuple[Column, Column]:
    """First and last day of the months a log covers, as lazy scalar columns."""
    bounds = log.agg(
        F.min(F.trunc("dt", "month")).alias("first"), F.max(F.last_day("dt")).alias("last")
    )
    return bounds.select("first").scalar(), bounds.select("last").scalar()


def site_days(
    sites: DataFrame, first: DateLike, last: DateLike, as_of: DateLike | None = None
) -> DataFrame:
    """``(domain, dt)`` for every site and day of the range, none after ``as_of``."""
    return sites.select("domain", F.explode(cal.days_between(first, last, as_of)).alias("dt"))


def site_hours(days: DataFrame) -> DataFrame:
    """``(domain, dt, hour)`` with the 24 hours of every day."""
    hours = F.sequence(F.lit(0), F.lit(23))
    return days.select("domain", "dt", F.explode(hours).alias("hour"))


def site_periods(days: DataFrame, grain: str) -> DataFrame:
    """The months or years a calendar touches, per site."""
    start = cal.period_start(F.col("dt"), grain)
    label = cal.period_label(F.col("start"), grain).alias(GRAIN_COLUMNS[grain])
    return days.select("domain", start.alias("start")).distinct().select("domain", label)


def zero_filled(calendar: DataFrame, counts: DataFrame) -> DataFrame:
    """Every calendar row with its counts, zeros where there are none."""
    return calendar.join(counts, calendar.columns, "left").fillna(0)


def calendar_days(months: DataFrame, as_of: DateLike | None = None) -> DataFrame:
    """The days of ``YYYY-MM`` months up to ``as_of`` with their display labels."""
    first = cal.month_start(F.col("month"))
    days = cal.days_between(first, F.last_day(first), as_of)
    day = F.col("dt")
    return months.select(F.explode(days).alias("dt")).select(
        "dt",
        cal.day_of_month(day).alias("day"),
        cal.month_label(day).alias("month_label"),
        cal.tab_label(day).alias("tab_label"),
        cal.weekday_offset(day).alias("weekday_offset"),
    )
