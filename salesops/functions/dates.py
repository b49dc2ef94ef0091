"""Date and calendar expressions (JVM-side Column expressions only).

The reports use the database's calendar functions; the ones whose meaning is
easy to get wrong on Spark are spelled out here:

* ``WEEK(d)`` / ``EXTRACT(WEEK FROM d)`` are Sunday-start weeks numbered
  0..53 (week 1 starts on the year's first Sunday).  Spark's ``weekofyear`` is
  ISO and differs on about half of all days, so it is never used.
* "same week/month/quarter as as_of" tests compare the period number *and*
  the year.  They are written as a closed date range, which parquet statistics
  can prune and which stays inside codegen, for a given day and for today.
* ``WEEKDAY`` numbers Monday 0, ``DAYOFWEEK`` numbers Sunday 1; Spark's
  ``weekday``/``dayofweek`` number the same way.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = _dt.date | Column | str | None


def as_date(d: DateLike) -> Column:
    """A date Column from a Python date, a Column, a column name, or None (today)."""
    if d is None:
        return F.current_date()
    if isinstance(d, Column):
        return d
    if isinstance(d, _dt.datetime):
        return F.lit(d.date())
    if isinstance(d, _dt.date):
        return F.lit(d)
    return F.col(d)


def day_offset(d: DateLike, days: int) -> Column:
    """``DATE_ADD(d, INTERVAL days DAY)`` (negative = ``DATE_SUB``)."""
    return F.date_add(as_date(d), days)


def months_back(d: DateLike, months: int) -> Column:
    """``d - INTERVAL months MONTH``; the day clamps to the month end, as in SQL."""
    return F.add_months(as_date(d), -months)


def sunday_week(d: DateLike) -> Column:
    """Week number with weeks starting on Sunday, 0..53 (the database default)."""
    d = as_date(d)
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


# -- period bounds ----------------------------------------------------------

def period_bounds(as_of: DateLike, unit: str) -> tuple[Column, Column]:
    """First and last day with the same week / month / quarter number and year as
    ``as_of``.  They are constants wherever ``as_of`` is one, the current date
    included, so the optimizer folds them and a range on them reaches the scan."""
    a = as_date(as_of)
    if unit == "month":
        return F.trunc(a, "month"), F.last_day(a)
    if unit == "quarter":
        first = F.trunc(a, "quarter")
        return first, F.last_day(F.add_months(first, 2))
    if unit != "week":
        raise ValueError(f"no period {unit!r}")
    sunday, new_year = F.date_sub(a, F.dayofweek(a) - 1), F.trunc(a, "year")
    return F.greatest(sunday, new_year), F.least(F.date_add(sunday, 6), F.date_sub(F.add_months(new_year, 12), 1))


def same_period(d: DateLike, as_of: DateLike, unit: str) -> Column:
    """``UNIT(d) = UNIT(as_of) AND YEAR(d) = YEAR(as_of)`` for week/month/quarter,
    as a range predicate on ``d``."""
    low, high = period_bounds(as_of, unit)
    d = as_date(d)
    return (d >= low) & (d <= high)


def same_week(d: DateLike, as_of: DateLike) -> Column:
    return same_period(d, as_of, "week")


def same_month(d: DateLike, as_of: DateLike) -> Column:
    return same_period(d, as_of, "month")


def same_quarter(d: DateLike, as_of: DateLike) -> Column:
    return same_period(d, as_of, "quarter")


def last_days(d: DateLike, as_of: DateLike, days: int) -> Column:
    """``d BETWEEN as_of - days AND as_of``."""
    a = as_date(as_of)
    return as_date(d).between(F.date_sub(a, days), a)


# -- working-day calendar ---------------------------------------------------

def monday_of(d: DateLike) -> Column:
    d = as_date(d)
    return F.date_sub(d, F.weekday(d))


def week_days(d: DateLike) -> Column:
    """Array of the Monday..Sunday days of ``d``'s week."""
    m = monday_of(d)
    return F.sequence(m, F.date_add(m, 6))


def month_days(d: DateLike) -> Column:
    """Array of the days of ``d``'s month."""
    d = as_date(d)
    return F.sequence(F.trunc(d, "month"), F.last_day(d))


def _not_sunday(x: Column) -> Column:
    return F.dayofweek(x) != 1


def working_days_week(d: DateLike) -> Column:
    """Days of the Monday-start week other than Sunday."""
    return F.size(F.filter(week_days(d), _not_sunday))


def days_passed_week(d: DateLike) -> Column:
    """Working days of the week up to and including ``d``."""
    d = as_date(d)
    return F.size(F.filter(week_days(d), lambda x: _not_sunday(x) & (x <= d)))


def working_days_month(d: DateLike) -> Column:
    """Days of the month other than Sundays."""
    return F.size(F.filter(month_days(d), _not_sunday))


def day_of_month(d: DateLike) -> Column:
    return F.dayofmonth(as_date(d))


def calendar_parts(d: DateLike) -> dict[str, Column]:
    """The database calendar functions the reports use, by name."""
    d = as_date(d)
    return {
        "weekday": F.weekday(d),          # Monday = 0
        "dayofweek": F.dayofweek(d),      # Sunday = 1
        "dayofmonth": F.dayofmonth(d),
        "last_day": F.last_day(d),
        "month_start": F.trunc(d, "month"),
        "week": sunday_week(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "year": F.year(d),
    }
