"""Windows over tables that already have one row per day (or week, or position).

Such tables are bounded by the calendar, so a window in one task is fine here; none of these
functions is meant for event rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.functions.numbers import ratio, round_signed


def trailing_avg(daily: DataFrame, cols: dict[str, str], order: Sequence[str] = ("date",), n: int = 7, digits: int | None = 1) -> DataFrame:
    """Mean of the last ``n`` rows; ``cols`` maps input to output names."""
    w = Window.orderBy(*order).rowsBetween(1 - n, 0)
    return daily.withColumns({out: _rounded(F.avg(c).over(w), digits) for c, out in cols.items()})


def centred_avg(daily: DataFrame, cols: dict[str, str], order: Sequence[str] = ("date",), n: int = 7, digits: int | None = None) -> DataFrame:
    """Mean of ``n`` rows around each row, null where fewer exist."""
    w = Window.orderBy(*order).rowsBetween(-(n // 2), n // 2)
    full = F.count("*").over(w) == n
    return daily.withColumns({out: F.when(full, _rounded(F.avg(c).over(w), digits)) for c, out in cols.items()})


def pct_change(daily: DataFrame, col: str, lag: int, name: str, order: Sequence[str] = ("date",), previous: str | None = None) -> DataFrame:
    """Percent change against ``lag`` rows earlier; null without one or when it is zero."""
    before = F.lag(col, lag).over(Window.orderBy(*order))
    changed = daily.withColumn("_before", before)
    changed = changed.withColumn(name, round_signed((F.col(col) - F.col("_before")) * 1e2 / F.nullif(F.col("_before"), F.lit(0)), 1))
    return changed.withColumnRenamed("_before", previous) if previous else changed.drop("_before")


def first_in_group(table: DataFrame, value: str, by: Sequence[str], order: str, name: str) -> DataFrame:
    """Value of the group's first row."""
    return table.withColumn(name, F.first(value).over(Window.partitionBy(*by).orderBy(order)))


def delta(table: DataFrame, col: str, order: str, name: str, digits: int = 1) -> DataFrame:
    return table.withColumn(name, round_signed(F.col(col) - F.lag(col).over(Window.orderBy(order)), digits))


def dispersion(table: DataFrame, col: str, digits: int = 4) -> DataFrame:
    """Mean, extremes, sample deviation and coefficient of variation."""
    row = table.agg(F.avg(col).alias("m"), F.max(col).alias("max"), F.min(col).alias("min"), F.stddev(col).alias("s"))
    return row.select(
        round_signed(F.col("m"), digits).alias("mean"), "max", "min",
        round_signed(F.col("s"), digits).alias("stddev"),
        round_signed(ratio(F.col("s"), F.col("m")), digits).alias("cv"),
    )


def peaks(table: DataFrame, key: str, value: str) -> DataFrame:
    """Largest and smallest value with their keys (smallest key on ties) and the ratio between them."""
    return table.agg(
        F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))).alias("hi"),
        F.min(F.struct(F.col(value).alias("v"), F.col(key).alias("k"))).alias("lo"),
    ).select(
        F.col("hi.k").cast("string").alias("peak_key"),
        (-F.col("hi.v")).alias("peak"),
        F.col("lo.k").cast("string").alias("low_key"),
        F.col("lo.v").alias("low"),
        round_signed(ratio(-F.col("hi.v") * 1e0, F.col("lo.v")), 4).alias("ratio"),
    )


def _rounded(x: Column, digits: int | None) -> Column:
    return x if digits is None else round_signed(x, digits)
