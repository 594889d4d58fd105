"""Aggregate expressions shared by the reports.

Time totals are summed in whole milliseconds: exact in any order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.numbers import exact_mean, flag, round_half_even, round_half_up


def plays() -> Column:
    return F.count("*")


def skips() -> Column:
    return F.count_if(F.col("is_skip"))


def hours(digits: int = 1) -> Column:
    return round_half_up(F.sum("ms_played") / 3.6e6, digits)


def minutes(digits: int = 1) -> Column:
    return round_half_up(F.sum("ms_played") / 6e4, digits)


def avg_seconds(digits: int = 1) -> Column:
    return round_half_up(F.sum("ms_played") / 1e3 / F.count("*"), digits)


def skip_pct(digits: int = 1) -> Column:
    return round_half_up(F.avg(flag(F.col("is_skip"))) * 1e2, digits)


def completion(digits: int = 1) -> Column:
    return round_half_up(exact_mean(F.col("percent_played")), digits)


def skip_rate3() -> Column:
    return round_half_even(F.avg(flag(F.col("is_skip"))), 3)


def completion3() -> Column:
    return round_half_even(exact_mean(F.col("percent_played")), 3)


def shuffle_rate3() -> Column:
    return round_half_even(F.avg(flag(F.col("shuffle"))), 3)
