"""Text and boolean clean-up, and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.constants import TRUE_TEXTS, UNKNOWN


def to_bool(x: Column) -> Column:
    """TRUE/T in any case is true; anything else, null too, is false."""
    return F.coalesce(F.upper(x.cast("string")).isin(*TRUE_TEXTS), F.lit(False))


def tidy(x: Column) -> Column:
    """Trimmed text, 'Unknown' when empty or null."""
    trimmed = F.trim(x)
    return F.when(trimmed.isNull() | (trimmed == ""), UNKNOWN).otherwise(trimmed)


def relabel(x: Column, labels: dict[str, str], default: Column) -> Column:
    out = None
    for value, label in labels.items():
        out = (F.when if out is None else out.when)(x == value, F.lit(label))
    return out.otherwise(default)


def ellipsis(x: Column, length: int = 20) -> Column:
    """First ``length`` characters, with dots when something was cut."""
    return F.when(F.length(x) > length, F.concat(F.substring(x, 1, length), F.lit("..."))).otherwise(x)


def whole_text(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def grouped_text(x: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(x.cast("bigint"), 0)


def one_decimal_text(x: Column) -> Column:
    return x.cast("decimal(20,1)").cast("string")


def percent_text(x: Column) -> Column:
    return F.concat(one_decimal_text(x), F.lit("%"))
