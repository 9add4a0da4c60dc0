"""Calendar column expressions on week-ending dates. Everything stays inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The length of a year in weeks and in days.
WEEKS_PER_YEAR = 52.1775
DAYS_PER_YEAR = 365.25

# Fixed values, US federal holidays on a fixed date: (month, day, first year).
FIXED_HOLIDAYS = ((1, 1, 1), (6, 19, 2021), (7, 4, 1), (11, 11, 1), (12, 25, 1))

# Fixed values, US federal holidays on the nth weekday of a month:
# (month, first possible day, last possible day, days after Monday, first year).
FLOATING_HOLIDAYS = (
    (1, 15, 21, 0, 1986),
    (2, 15, 21, 0, 1),
    (5, 25, 31, 0, 1),
    (9, 1, 7, 0, 1),
    (10, 8, 14, 0, 1),
    (11, 22, 28, 3, 1),
)


def week_ending(ds: Column) -> Column:
    """The Sunday that closes the Monday-to-Sunday week of ``ds``."""
    return F.date_add(F.trunc(ds, "week"), 6)


def iso_week(week_end: Column) -> Column:
    return F.weekofyear(week_end)


def holiday_flag(week_end: Column) -> Column:
    """1 if a US federal holiday, or the day it is observed, falls in the week, else 0.

    A fixed date on a Saturday is observed on the Friday before, in the same week; on a Sunday it is
    observed on the Monday after, in the next week. So a week counts the fixed dates from the Sunday
    before it up to its own. A span over the turn of the year always holds 1 January, so the year of
    the week end is the only one to look at. Floating holidays are told by the day of the month of
    the Monday (or Thursday) of the week. No join is needed.
    """
    year = F.year(week_end)
    hits = [
        F.make_date(year, F.lit(month), F.lit(day)).between(F.date_sub(week_end, 7), week_end)
        & (year >= since)
        for month, day, since in FIXED_HOLIDAYS
    ]
    for month, first, last, after_monday, since in FLOATING_HOLIDAYS:
        day = F.date_sub(week_end, 6 - after_monday)
        hits.append(
            (F.month(day) == month) & F.dayofmonth(day).between(first, last) & (F.year(day) >= since)
        )
    any_hit = hits[0]
    for hit in hits[1:]:
        any_hit = any_hit | hit
    return F.when(any_hit, 1).otherwise(0)


def fourier_pair(position: Column, k: int, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi * k) * position / F.lit(period)
    return F.sin(angle), F.cos(angle)
