"""Crosstabs: with columns where the domain is fixed (hours, parts of a day), long otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.functions.numbers import round_half_up


def pivot_counts(df: DataFrame, rows: str, col: str, values: Sequence, prefix: str = "") -> DataFrame:
    """Counts of ``col`` values per ``rows`` value, zero where none."""
    table = df.groupBy(rows).pivot(col, list(values)).count().na.fill(0)
    return table.select(rows, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def pivot_share(df: DataFrame, rows: str, col: str, values: Sequence, prefix: str = "", digits: int = 4) -> DataFrame:
    """The same as percent of the row's total."""
    table = pivot_counts(df, rows, col, values, prefix)
    names = [f"{prefix}{v}" for v in values]
    total = reduce(lambda a, b: a + b, [F.col(f"`{n}`") for n in names])
    shares = [round_half_up(F.col(f"`{n}`") * 1e2 / F.nullif(total, F.lit(0)), digits).alias(n) for n in names]
    return table.select(rows, *shares)


def cross_counts(df: DataFrame, rows: str, col: str) -> DataFrame:
    """Plays of every value of ``col``, null among them, per ``rows`` value: ``rows, col, n``."""
    return df.groupBy(rows, col).agg(F.count("*").alias("n"))


def cross_shares(df: DataFrame, rows: str, col: str, digits: int = 4) -> DataFrame:
    """The same with the percent of all plays of the row."""
    counts = cross_counts(df, rows, col)
    total = F.sum("n").over(Window.partitionBy(rows))
    return counts.withColumn("share", round_half_up(F.col("n") * 1e2 / total, digits))
