"""Joining aggregates back to events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.sources.staging import stage


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join on equal keys in which nulls match each other; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_key_{k}" for k in keys])


def attach(events: DataFrame, aggregate: DataFrame, keys: Sequence[str], name: str, how: str = "left") -> DataFrame:
    """Events with the aggregate's columns.

    The aggregate (one row per key) is staged, so Spark knows its size: under the broadcast
    threshold the events do not move at all, above it both sides are plain exchanges and a hot
    key is split by adaptive skew handling. Null keys get the aggregate of the null key.
    """
    return join_on(events, stage(aggregate, name), keys, how)


def with_modes(grouped: DataFrame, rows: DataFrame, keys: Sequence[str], modes: dict[str, str]) -> DataFrame:
    """Adds, per key, the most frequent value of a column (ties: the smallest; nulls don't count) as ``{name: column}``.

    Rows are counted per key and value first, combined map-side, so that only counts meet per key: a mode over the
    rows themselves would sort them once a task has seen many keys.
    """
    for name, col in modes.items():
        counts = rows.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
        best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v"))).alias("_best"))
        grouped = join_on(grouped, best.select(*keys, F.col("_best.v").alias(name)), keys)
    return grouped


def with_distinct(grouped: DataFrame, rows: DataFrame, keys: Sequence[str], counts: dict[str, str]) -> DataFrame:
    """Adds, per key, how many values a column has (nulls don't count) as ``{name: column}``, by two hash aggregates
    for each instead of one pass that repeats every row."""
    for name, col in counts.items():
        values = rows.where(F.col(col).isNotNull()).select(*keys, col).distinct()
        found = values.groupBy(*keys).agg(F.count("*").alias(name))
        grouped = join_on(grouped, found, keys).withColumn(name, F.coalesce(name, F.lit(0)))
    return grouped


def with_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Side-by-side columns: a projection, no join."""
    return df.withColumns(exprs)


def one_row(table: DataFrame) -> Column:
    """A one-row table (a global aggregate, say) as a struct column: a scalar subquery, not a join."""
    return table.select(F.struct(*table.columns)).scalar()


def share_of_total(table: DataFrame, value: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """``value`` as a percent of its total, overall or within groups, on an already grouped table."""
    totals = table.groupBy(*within).agg(F.sum(value).alias("_total"))
    if within:
        return table.join(totals, list(within)).withColumn(name, F.col(value) * 1e2 / F.col("_total")).drop("_total")
    return table.withColumn(name, F.col(value) * 1e2 / totals.scalar())


def normalise_by_max(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds ``<col>_norm`` = col / max(col) over a grouped table."""
    top = one_row(table.agg(*[F.max(c).alias(c) for c in cols]))
    return table.withColumns({f"{c}_norm": F.col(c) / top[c] for c in cols})
