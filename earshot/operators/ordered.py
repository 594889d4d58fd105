"""Work that needs the order of the whole log, without a one-partition window.

The log is range-partitioned and sorted once and staged with a dense ``row_index``. A hot
timestamp or key is no problem: the range bounds include the tie-break. Everything else cuts
the index into equal chunks, so tasks are even whatever the data looks like:

- lags and rolling means copy the last rows of each chunk into the next one;
- running sums add the totals of earlier chunks, a table of at most ``MAX_CHUNKS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from earshot.operators.joins import attach
from earshot.sources.staging import stage

MAX_CHUNKS = 100_000
CHUNK_FLOOR = 10_000
LOG_ORDER = ("timestamp", "event_id")


@dataclass(frozen=True)
class OrderedLog:
    """Rows with ``row_index`` 1..n, in order of ``keys`` and then the log order."""

    rows: DataFrame
    keys: tuple[str, ...] = ()
    chunk_rows: int | None = None

    @cached_property
    def count(self) -> int:
        return self.rows.count()

    @cached_property
    def chunk(self) -> int:
        """Rows per chunk: four chunks per shuffle task, within the floor and the chunk limit."""
        if self.chunk_rows:
            return self.chunk_rows
        tasks = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        even = min(-(-self.count // (4 * tasks)), 1_000_000)
        return max(even, CHUNK_FLOOR, -(-self.count // MAX_CHUNKS))

    def _chunk_of(self, chunk: int | None = None) -> Column:
        return F.expr(f"(row_index - 1) div {chunk or self.chunk}")

    def history(self, columns: dict[str, Callable[[WindowSpec], Column]], reach: int) -> DataFrame:
        """Window columns that look back at most ``reach`` rows (within the key, if there is one)."""
        if reach <= 0:
            raise ValueError("reach must be positive")
        chunk = max(self.chunk, reach)
        near_end = (F.col("row_index") - 1) % chunk >= chunk - reach
        home = F.col("_home")
        placed = self.rows.withColumn("_home", self._chunk_of(chunk)).withColumn(
            "_chunk", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)))
        )
        w = Window.partitionBy("_chunk", *self.keys).orderBy("row_index")
        seen = placed.withColumns({name: make(w) for name, make in columns.items()})
        return seen.where(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")

    def running_sum(self, value: Column, name: str = "running") -> DataFrame:
        """Inclusive running sum of a whole-number expression, restarted for each key."""
        rows = self.rows.withColumn("_value", value.cast("bigint")).withColumn("_chunk", self._chunk_of())
        totals = rows.groupBy("_chunk").agg(F.sum("_value").alias("_total"))
        earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select("_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
        within = Window.partitionBy("_chunk").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
        summed = rows.join(F.broadcast(before), "_chunk").withColumn(name, F.col("_before") + F.sum("_value").over(within))
        if self.keys:
            start = summed.groupBy(*self.keys).agg(F.min_by(F.col(name) - F.col("_value"), "row_index").alias("_start"))
            summed = attach(summed, start, self.keys, "running_starts").withColumn(name, F.col(name) - F.col("_start")).drop("_start")
        return summed.drop("_value", "_chunk", "_before")


def order_log(df: DataFrame, order_by: Sequence[str] = LOG_ORDER, keys: Sequence[str] = (), chunk_rows: int | None = None, partitions: int | None = None) -> OrderedLog:
    """Sort once, number the rows, stage the result."""
    by = [*keys, *order_by]
    part = F.spark_partition_id()
    position = F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)
    # without a number adaptive execution may merge neighbouring ranges, never reorder them
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    numbered = ranged.sortWithinPartitions(*by).withColumns({"_part": part, "_position": position})
    staged = stage(numbered, "ordered")
    # one row per range partition: at most spark.sql.shuffle.partitions rows
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    index = (F.col("_offset") + F.col("_position") + 1).alias("row_index")
    rows = staged.join(F.broadcast(offsets), "_part").select(*df.columns, index)
    return OrderedLog(rows, tuple(keys), chunk_rows)


def previous(col: str, n: int = 1) -> Callable[[WindowSpec], Column]:
    return lambda w: F.lag(col, n).over(w)


def rolling_mean(value: Column, n: int = 5, leak_free: bool = False) -> Callable[[WindowSpec], Column]:
    """Mean of the last ``n`` rows, this one included unless ``leak_free``."""
    first, last = (-n, -1) if leak_free else (1 - n, 0)
    return lambda w: F.avg(value).over(w.rowsBetween(first, last))


def ordered_lag(df: DataFrame, ts: str = "timestamp", n: int = 1, keys: Sequence[str] = (), tiebreak: str = "event_id", chunk_rows: int | None = None) -> DataFrame:
    """Adds the time of the ``n``-th previous row and the seconds since then."""
    log = order_log(df, (ts, tiebreak), keys, chunk_rows)
    seen = log.history({"prev_timestamp": previous(ts, n)}, reach=n)
    gap = (F.unix_micros(ts) - F.unix_micros("prev_timestamp")) / 1e6
    return seen.withColumn("gap_seconds", gap)


def with_previous(log: OrderedLog, first_is_switch: bool = True) -> DataFrame:
    """Platform, skip and completion of the previous play, and whether the platform changed."""
    seen = log.history(
        {
            "prev_platform": previous("platform"),
            "prev_track_skip": previous("is_skip"),
            "prev_track_completion": previous("percent_played"),
        },
        reach=1,
    )
    return fill_previous(seen, first_is_switch)


def fill_previous(seen: DataFrame, first_is_switch: bool = True) -> DataFrame:
    changed = F.coalesce(F.col("platform") != F.col("prev_platform"), F.lit(first_is_switch))
    return seen.withColumns({
        "platform_switch": changed,
        "prev_track_skip": F.coalesce("prev_track_skip", F.lit(False)),
        "prev_track_completion": F.coalesce("prev_track_completion", F.lit(0.0)),
    })


def ordered_rolling(log: OrderedLog, n: int = 5, leak_free: bool = False) -> DataFrame:
    """Rolling skip rate and completion over the last ``n`` plays."""
    skip = F.when(F.col("is_skip"), 1.0).otherwise(0.0)
    return log.history(
        {
            "rolling_5_skip_rate": rolling_mean(skip, n, leak_free),
            "rolling_5_avg_completion": rolling_mean(F.col("percent_played"), n, leak_free),
        },
        reach=n if leak_free else max(n - 1, 1),
    )
