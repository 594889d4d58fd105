"""Rounding, guarded division and binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half-up rounding of a value that is never negative."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def round_signed(x: Column, digits: int = 0) -> Column:
    """Half away from zero, for values of either sign."""
    scale = float(10**digits)
    return F.when(x < 0, 0.0 - F.floor(0.5 - x * scale) / scale).otherwise(F.floor(x * scale + 0.5) / scale)


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Scale, round to the even integer on ties, scale back."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null when ``b`` is zero."""
    return a / F.nullif(b, F.lit(0))


def exact_sum(x: Column) -> Column:
    """Sum in whole billionths: exact, so it does not depend on the order of rows and adds up in steps."""
    return F.sum(F.rint(x * 1e9).cast("decimal(20,0)"))


def exact_mean(x: Column) -> Column:
    """Mean that does not depend on the order of rows.

    Floating sums change in the last digit with the order of addition, which shows after rounding
    when the mean sits on a tie.
    """
    return exact_sum(x).cast("double") / 1e9 / F.count(x)


def cap(x: Column, high: float) -> Column:
    """Upper bound that keeps nulls (``least`` would replace them)."""
    return F.when(x > high, F.lit(high)).otherwise(x)


def right_closed_bin(x: Column, bins: Sequence[tuple[float | None, str]], low: float = 0) -> Column:
    """Label of the bin ``(previous edge, edge]``; at or below ``low`` and past the last edge: null."""
    out = F.when(x <= low, F.lit(None).cast("string"))
    for edge, label in bins:
        out = out.when(x.isNotNull() if edge is None else x <= edge, F.lit(label))
    return out


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (also for null)."""
    return F.when(condition, 1.0).otherwise(0.0)


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number from 0; the last bin holds its right edge."""
    width = (high - low) / float(bins)
    position = F.when(width > 0, F.floor((x - low) / width)).otherwise(0).cast("bigint")
    return F.when(position >= bins, F.lit(bins - 1)).otherwise(position).cast("bigint")
