"""Row-level features: projections only, except where a per-track or category table is joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from earshot import constants as K
from earshot.functions import numbers, times
from earshot.operators.joins import attach
from earshot.operators.ordered import order_log
from earshot.sources.staging import stage

MAX_CATEGORIES = 1000


def add_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "hour_of_day": F.hour(t),
        "day_of_week": F.date_format(t, "EEEE"),
        "day_of_week_num": F.weekday(t),
        "month": F.month(t),
        "year": F.year(t),
        "date": F.to_date(t),
        "week_of_year": F.weekofyear(t),
    })


def add_week_flags(df: DataFrame) -> DataFrame:
    weekend = F.col("day_of_week_num") >= 5
    return df.withColumns({"is_weekend": weekend, "is_workday": ~weekend})


def add_time_of_day(df: DataFrame) -> DataFrame:
    return df.withColumn("time_of_day", times.day_part(F.col("hour_of_day")))


def add_hour_flags(df: DataFrame) -> DataFrame:
    hour = F.col("hour_of_day")
    return df.withColumns({
        "is_peak_hour": hour.isin(*K.PEAK_HOURS),
        "is_morning_commute": hour.isin(*K.MORNING_COMMUTE),
        "is_evening_commute": hour.isin(*K.EVENING_COMMUTE),
        "is_late_night": hour.isin(*K.LATE_NIGHT),
        "is_night": hour.isin(*K.NIGHT_HOURS),
    })


def add_season(df: DataFrame) -> DataFrame:
    return df.withColumn("season", times.season(F.col("month")))


def add_durations(df: DataFrame, ms: str = "ms_played") -> DataFrame:
    return df.withColumns({"seconds_played": F.col(ms) / 1e3, "minutes_played": F.col(ms) / 1e3 / 60})


def longest_plays(df: DataFrame, key: str = "track_uri", ms: str = "ms_played") -> DataFrame:
    return df.groupBy(key).agg(F.max(ms).alias("estimated_track_length_ms"))


def add_max_length(df: DataFrame, key: str = "track_uri", ms: str = "ms_played") -> DataFrame:
    """Longest play of a track stands for its length. Aggregate and join: a window would put a
    popular track's plays in one task."""
    return attach(df, longest_plays(df, key, ms), [key], "track_lengths").withColumn(
        "track_length_seconds", F.col("estimated_track_length_ms") / 1e3
    )


def add_percent_played(df: DataFrame) -> DataFrame:
    length = F.col("estimated_track_length_ms")
    percent = F.when(length > 0, F.col("ms_played") * 1e2 / length).otherwise(0.0)
    return df.withColumn("percent_played", numbers.cap(percent, 100.0))


def add_length_bin(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "track_length_category", numbers.right_closed_bin(F.col("track_length_seconds"), K.LENGTH_BINS)
    )


def add_is_skip(df: DataFrame, below: float = K.SKIP_BELOW_PERCENT, reasons: Sequence[str] = K.SKIP_REASONS) -> DataFrame:
    skip = F.col("skipped") | (F.col("percent_played") < below) | F.col("reason_end").isin(*reasons)
    return df.withColumn("is_skip", F.coalesce(skip, F.lit(False)))


def add_quality(df: DataFrame, high: float = K.HIGH_PERCENT, medium: float = K.MEDIUM_PERCENT) -> DataFrame:
    p = F.col("percent_played")
    return df.withColumn("listening_quality", F.when(p >= high, "High").when(p >= medium, "Medium").otherwise("Low"))


def add_engagement(df: DataFrame) -> DataFrame:
    completion = F.col("percent_played") / 1e2
    kept = F.when(F.col("is_skip"), 0.0).otherwise(1.0)
    return df.withColumns({
        "completion_score": completion,
        "engagement_score": completion * K.COMPLETION_WEIGHT + kept * K.NO_SKIP_WEIGHT,
    })


def add_reason_flags(df: DataFrame) -> DataFrame:
    start, end = F.col("reason_start"), F.col("reason_end")
    return df.withColumns({
        "is_autoplay": start == "autoplay",
        "is_manual_start": start.isin(*K.MANUAL_START_REASONS),
        "is_manual_skip": end.isin(*K.SKIP_REASONS),
        "is_natural_end": end == "trackdone",
    })


def add_session_size_flags(df: DataFrame, binge: int = K.BINGE_TRACKS, short: int = K.SHORT_TRACKS) -> DataFrame:
    n = F.col("session_track_count")
    return df.withColumns({"is_binge_session": n >= binge, "is_short_session": n <= short})


def add_crosses(df: DataFrame) -> DataFrame:
    weekend = F.when(F.col("is_weekend"), "True").otherwise("False")
    return df.withColumns({
        "hour_platform_interaction": F.concat_ws("_", F.col("hour_of_day").cast("string"), "platform"),
        "weekend_platform_interaction": F.concat_ws("_", weekend, "platform"),
    })


def code_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code): each value's position in its column's sorted order, from 0.

    One pass for all columns; the window runs over distinct values, never over events.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    values = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    return values.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1)


def attach_codes(df: DataFrame, codes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds ``<col>_encoded`` from a staged code table, null as -1."""
    for c in cols:
        own = codes.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_encoded"))
        df = df.join(own, c, "left")
    return df.na.fill(-1, subset=[f"{c}_encoded" for c in cols])


def encode_sorted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return attach_codes(df, stage(code_table(df, cols), "codes"), cols)


def add_nonlinear(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "completion_squared": F.col("percent_played") * F.col("percent_played"),
        "track_length_log": F.log1p("track_length_seconds"),
    })


def top_categories(df: DataFrame, col: str, k: int | None = None) -> list[str]:
    """Values of a category, most frequent first; a list because each becomes a column."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    found = counts.orderBy(F.desc("n"), col).limit(k or MAX_CATEGORIES + 1).select(col).collect()
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"{col} has more than {MAX_CATEGORIES} values: too many for one column each")
    return [row[0] for row in found]


def one_hot(df: DataFrame, col: str, values: Sequence[str] | None = None, top_k: int | None = None) -> DataFrame:
    """One 0/1 column per value, ``<col>_<value>``; all values or the ``top_k`` most frequent."""
    values = values if values is not None else top_categories(df, col, top_k)
    return df.withColumns({f"{col}_{v}": F.when(F.col(col) == v, 1).otherwise(0) for v in values})


def dense_codes(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """``<col>, code`` for each value in sorted order from 0, and how many there are; null has no code.

    The codes are places in a range-sorted index of the distinct values, so no task and no driver lists them.
    """
    log = order_log(df.where(F.col(col).isNotNull()).select(col).distinct(), (col,))
    return log.rows.select(col, (F.col("row_index") - 1).alias("code")), log.count


def one_hot_sparse(df: DataFrame, col: str, output: str | None = None) -> DataFrame:
    """A sparse 0/1 vector ``<col>_onehot`` over all values of a column, however many there are; all zero for null.

    Rows carry one index each. A vector is written by its fields and read back as a vector column, so no function runs on
    single rows.
    """
    output = output or f"{col}_onehot"
    codes, size = dense_codes(df, col)
    coded = attach(df, codes.withColumnRenamed("code", f"_{output}"), (col,), "codes")
    index = F.col(f"_{output}").cast("int")
    some = index.isNotNull()
    none_i, none_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    fields = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"), F.when(some, F.array(index)).otherwise(none_i).alias("indices"),
        F.when(some, F.array(F.lit(1.0))).otherwise(none_v).alias("values"),
    )
    schema = T.StructType([*df.schema.fields, T.StructField(output, VectorUDT())])
    return stage(coded.select(*df.columns, fields.alias(output)), "one_hot", schema)


def add_length_flags(df: DataFrame) -> DataFrame:
    s = F.col("track_length_seconds")
    return df.withColumns({
        "is_long_track": F.when(s > 240, 1).otherwise(0),
        "is_short_track": F.when(s < 120, 1).otherwise(0),
        "shuffle_int": F.col("shuffle").cast("int"),
    })


def select_available(df: DataFrame, want: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wanted columns that exist, as doubles with nulls as zero."""
    have = [c for c in want if c in df.columns]
    number: list[Column] = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in have]
    return df.select(*keep, *number)


def temporal(df: DataFrame) -> DataFrame:
    for step in (add_calendar, add_week_flags, add_time_of_day, add_hour_flags, add_season):
        df = df.transform(step)
    return df


def add_behaviour(df: DataFrame) -> DataFrame:
    """Everything that follows from play time and ``estimated_track_length_ms``."""
    df = df.withColumn("track_length_seconds", F.col("estimated_track_length_ms") / 1e3)
    for step in (add_durations, add_percent_played, add_length_bin, add_is_skip, add_quality, add_engagement):
        df = df.transform(step)
    return df


def wide_plays(df: DataFrame) -> DataFrame:
    """The table every report reads: a cleaned log with calendar and behaviour columns."""
    return df.transform(add_max_length).transform(add_behaviour).transform(temporal)
