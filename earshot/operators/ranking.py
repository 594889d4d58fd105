"""Ranks over large grouped tables without sorting them in one task.

A rank depends on how many rows lie below a value. Rows are counted by (measure, value), all measures in one pass, the
counts go into one range-sorted index, and running sums over its chunks give every value's place. Nothing is ordered in
a single task, whatever the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.joins import join_on
from earshot.operators.ordered import order_log
from earshot.sources.staging import stage


@dataclass(frozen=True)
class Rank:
    """RANK of a column, or PERCENT_RANK with ``percent``; nulls are the least values."""

    of: str
    ascending: bool = True
    percent: bool = False


def add_rank_columns(table: DataFrame, ranks: Mapping[str, Rank]) -> DataFrame:
    """``table`` with a rank column for each name. Ranked columns are compared as doubles."""
    measures = sorted({r.of for r in ranks.values()})
    melted = table.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_m"), F.col(f"`{c}`").cast("double").alias("_v")) for i, c in enumerate(measures)])))
    counts = melted.groupBy("_m", "_v").agg(F.count("*").alias("_n"))
    log = order_log(counts, ("_v",), ("_m",))
    summed = type(log)(log.rows, chunk_rows=log.chunk_rows).running_sum(F.col("_n"), "_upto")
    placed = stage(summed.select("_m", "_v", "_n", "_upto"), "places")
    rows = placed.where("_m = 0").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    out = table
    for i, c in enumerate(measures):
        # every measure has all rows, so those of the measures before are so many times the rows
        own = placed.where(F.col("_m") == i).select("_v", "_n", (F.col("_upto") - i * rows).alias("_upto"))
        named = out.withColumn("_v", F.col(f"`{c}`").cast("double"))
        joined = join_on(named, own, ("_v",), "inner")
        out = joined.withColumns({name: _rank(r, rows) for name, r in ranks.items() if r.of == c}).drop("_v", "_n", "_upto")
    return out


def _rank(rank: Rank, rows: int) -> Column:
    below = F.col("_upto") - F.col("_n") if rank.ascending else rows - F.col("_upto")
    if not rank.percent:
        return below + 1
    return below / (rows - 1.0) if rows > 1 else F.lit(0.0)


def add_ranks(table: DataFrame, value: str, rank: str | None = None, percent_rank: str | None = None, ascending: bool = True) -> DataFrame:
    """RANK and PERCENT_RANK of one column."""
    wanted = {rank: Rank(value, ascending), percent_rank: Rank(value, ascending, True)}
    return add_rank_columns(table, {name: r for name, r in wanted.items() if name})


def add_ntile(table: DataFrame, buckets: int, order_by: Sequence[str], name: str) -> DataFrame:
    """NTILE over a total order, from the dense index of the sorted table."""
    log = order_log(table, order_by)
    small, larger = divmod(log.count, buckets)
    zero_based = F.col("row_index") - 1
    in_larger = larger * (small + 1)
    tile = F.when(zero_based < in_larger, F.expr(f"(row_index - 1) div {small + 1}"))
    if small:
        tile = tile.otherwise(larger + F.expr(f"(row_index - 1 - {in_larger}) div {small}"))
    return log.rows.withColumn(name, (tile + 1).cast("int")).drop("row_index")
