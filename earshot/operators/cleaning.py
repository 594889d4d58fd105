"""From raw text to a typed, deduplicated log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.constants import (
    BOOLEAN_COLUMNS, CRITICAL_COLUMNS, FILL_COLUMNS, MAX_PLAY_MS, TEXT_COLUMNS, TS_FORMAT, UNKNOWN,
)
from earshot.functions import numbers, texts


def drop_critical_nulls(df: DataFrame, cols: Sequence[str] = CRITICAL_COLUMNS) -> DataFrame:
    return df.na.drop(subset=list(cols))


def fill_unknown(df: DataFrame, cols: Sequence[str] = FILL_COLUMNS) -> DataFrame:
    return df.na.fill(UNKNOWN, subset=[c for c in cols if c in df.columns])


def to_bool(df: DataFrame, cols: Sequence[str] = BOOLEAN_COLUMNS) -> DataFrame:
    return df.withColumns({c: texts.to_bool(F.col(c)) for c in cols if c in df.columns})


def to_numeric(df: DataFrame, cols: Sequence[str] = ("ms_played",)) -> DataFrame:
    """Bad text becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols if c in df.columns})


def clean_text(df: DataFrame, cols: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: texts.tidy(F.col(c)) for c in cols if c in df.columns})


def parse_ts(df: DataFrame, col: str = "ts", fmt: str = TS_FORMAT) -> DataFrame:
    """Adds ``timestamp``; rows whose text does not parse are dropped."""
    return df.withColumn("timestamp", F.try_to_timestamp(F.col(col), F.lit(fmt))).na.drop(subset=["timestamp"])


def cap(df: DataFrame, col: str = "ms_played", high: float = MAX_PLAY_MS) -> DataFrame:
    return df.withColumn(col, numbers.cap(F.col(col), high))


def drop_negative(df: DataFrame, col: str = "ms_played") -> DataFrame:
    """Negative and missing values go."""
    return df.where(F.col(col) >= 0)


def dedupe(df: DataFrame) -> DataFrame:
    """Exact duplicates over all columns; Spark combines copies before the shuffle."""
    return df.dropDuplicates()


def typed(df: DataFrame) -> DataFrame:
    """Everything up to a typed log: one projection and filter, no shuffle."""
    return (
        df.transform(drop_critical_nulls)
        .transform(fill_unknown)
        .transform(to_bool)
        .transform(to_numeric)
        .transform(clean_text)
        .transform(parse_ts)
    )


def clean(df: DataFrame) -> DataFrame:
    """The whole cleaning chain."""
    return df.transform(typed).transform(cap).transform(drop_negative).transform(dedupe)
