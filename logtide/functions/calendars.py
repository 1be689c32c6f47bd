"""Dates, months and report periods as Column expressions."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Report grain -> name of its key column.
GRAIN_COLUMNS = {"day": "dt", "month": "month", "year": "year"}

DateLike = date | str | Column


def date_column(value: DateLike) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def month_range(month: str) -> tuple[date, date]:
    """First and last day of a ``YYYY-MM`` month given as an argument."""
    if not re.fullmatch("[0-9]{4}-[0-9]{1,2}", month):
        raise ValueError(f"not a YYYY-MM month: {month!r}")
    first = date(*map(int, month.split("-")), 1)
    return first, first.replace(day=monthrange(first.year, first.month)[1])


def year_range(year: str | int) -> tuple[date, date]:
    """First and last day of a year given as an argument."""
    return date(int(year), 1, 1), date(int(year), 12, 31)


def utc_today() -> Column:
    return F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def parse_date(text: Column) -> Column:
    """``YYYY-MM-DD`` as a date, null for anything else."""
    return F.when(
        text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd")
    )


def month_start(month: Column) -> Column:
    """First day of a ``YYYY-MM`` month; any other text is an error."""
    first = F.try_to_date(
        F.concat(
            F.substring_index(month, "-", 1),
            F.lit("-"),
            F.lpad(F.substring_index(month, "-", -1), 2, "0"),
            F.lit("-01"),
        ),
        "yyyy-MM-dd",
    )
    return F.when(month.rlike("^[0-9]{4}-[0-9]{1,2}$") & first.isNotNull(), first).otherwise(
        F.raise_error(F.concat(F.lit("not a YYYY-MM month: "), month)).cast("date")
    )


def days_between(first: DateLike, last: DateLike, as_of: DateLike | None = None) -> Column:
    """Array of all days from ``first`` to ``last``, none of them after ``as_of``."""
    first, last = date_column(first), date_column(last)
    if as_of is not None:
        last = F.least(last, date_column(as_of))
    return F.when(first <= last, F.sequence(first, last))


def period_start(day: Column, grain: str) -> Column:
    """First day of the period: a date, so it groups cheaper than its label."""
    return day if grain == "day" else F.trunc(day, grain)


def period_label(start: Column, grain: str) -> Column:
    """What a report calls a period: a date, ``YYYY-MM`` or a year number."""
    if grain == "day":
        return start
    return F.year(start) if grain == "year" else F.date_format(start, "yyyy-MM")


def day_of_month(day: Column) -> Column:
    return F.dayofmonth(day)


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM")


def tab_label(day: Column) -> Column:
    return F.date_format(day, "MMM d")


def weekday_offset(day: Column) -> Column:
    """Days since Monday."""
    return F.weekday(day)
