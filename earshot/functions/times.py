"""Calendar expressions over a timestamp or an hour column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.constants import AFTERNOON, DAY_PARTS, EVENING, MORNING, NIGHT


def day_part(hour: Column) -> Column:
    morning, afternoon, evening, night = DAY_PARTS
    return (
        F.when((hour < MORNING) | (hour >= NIGHT), night)
        .when(hour < AFTERNOON, morning)
        .when(hour < EVENING, afternoon)
        .otherwise(evening)
    )


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Fall")
    )


def micros_between(earlier: Column, later: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def seconds_between(earlier: Column, later: Column) -> Column:
    return micros_between(earlier, later) / 1e6


def minutes_between(earlier: Column, later: Column) -> Column:
    return micros_between(earlier, later) / 6e7


def whole_days_between(earlier: Column, later: Column) -> Column:
    """Full 24-hour periods, not calendar days."""
    return F.floor(micros_between(earlier, later) / 8.64e10).cast("bigint")


def week_start(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", ts))
