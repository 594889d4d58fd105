"""Data-quality measures, each as a small DataFrame from one pass where possible."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.constants import KNOWN_PLATFORMS, LONG_SKIP_MS, MAX_PLAY_MS, OLDEST_PLAUSIBLE, RAW_COLUMNS
from earshot.functions.numbers import round_half_up
from earshot.functions.texts import one_decimal_text, whole_text
from earshot.functions.times import whole_days_between
from earshot.operators import cleaning
from earshot.operators.quantiles import exact_quantiles, quantile_rows


def unpivot_row(row: DataFrame, values: dict[str, Column], name: str, value: str) -> DataFrame:
    """One row of named values as (name, value) rows."""
    pairs = [F.struct(F.lit(n).alias(name), v.alias(value)) for n, v in values.items()]
    return row.select(F.inline(F.array(*pairs)))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"), "n_rows") for c in cols]
    return counts.select(F.inline(F.array(*pairs))).select(
        "column", "n_missing", round_half_up(F.col("n_missing") * 1e2 / F.col("n_rows"), 4).alias("pct_missing")
    )


def dup_count(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    )


def near_dup_count(df: DataFrame, keys: Sequence[str] = ("track_uri",), ts: str = "timestamp", grain: str = "minute") -> DataFrame:
    """All members of groups that share the keys and the time grain."""
    return (
        df.groupBy(*keys, F.date_trunc(grain, F.col(ts)).alias("grain"))
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("near_duplicates"))
    )


def cardinality(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null values per column.

    Melting first turns many distinct counts into one two-column distinct, which is combined
    before the shuffle and leaves no single task holding a column's values.
    """
    cols = list(cols or df.columns)
    values = _melt(df, cols).where(F.col("value").isNotNull()).distinct()
    counts = values.groupBy("column").agg(F.count("*").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counts, "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 5, below: int = 20) -> DataFrame:
    """The ``k`` most frequent values of columns with fewer than ``below`` distinct ones."""
    counts = _melt(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("column").agg(F.count("*").alias("n_distinct")).where(F.col("n_distinct") < below)
    # row_number with a limit prunes each partition before the shuffle
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(few.select("column"), "column").select("column", "value", "n", "rank")


def _melt(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*pairs)))


def iqr_outliers(df: DataFrame, col: str = "ms_played", k: float = 1.5) -> DataFrame:
    """Quartiles, fences and how many values lie outside; counts only, nothing is changed."""
    q1, q3 = (F.lit(q).cast("double") for q in exact_quantiles(df, {col: (0.25, 0.75)})[col])
    lo, hi = q1 - (q3 - q1) * k, q3 + (q3 - q1) * k
    outside = F.count_if((F.col(col) < lo) | (F.col(col) > hi))
    return df.agg(outside.alias("n_outliers")).select(
        q1.alias("q1"), q3.alias("q3"), lo.alias("lo"), hi.alias("hi"), "n_outliers"
    )


def ts_range(df: DataFrame, now: str, floor: str = OLDEST_PLAUSIBLE, ts: str = "timestamp") -> DataFrame:
    """First and last time, whole days between, and rows in the future (a day of grace) or before ``floor``."""
    late = F.lit(now).cast("timestamp") + F.expr("interval '1' day")
    return df.agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        whole_days_between(F.min(ts), F.max(ts)).alias("days"),
        F.count_if(F.col(ts) > late).alias("n_future"),
        F.count_if(F.col(ts) < F.lit(floor).cast("timestamp")).alias("n_too_old"),
    )


def domain_violations(df: DataFrame, col: str = "platform", allowed: Sequence[str] = KNOWN_PLATFORMS) -> DataFrame:
    """Each value outside the list, null among them, with its row count."""
    return df.where(~F.coalesce(F.col(col).isin(*allowed), F.lit(False))).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def rule_violations(df: DataFrame, rule: Column | None = None) -> DataFrame:
    """Rows that break a rule; by default, marked skipped yet played over four minutes."""
    rule = rule if rule is not None else F.col("skipped") & (F.col("ms_played") > LONG_SKIP_MS)
    return df.agg(F.count_if(rule).alias("violations"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per numeric column."""
    measures = {"n": F.count, "mean": F.avg, "stddev": F.stddev, "min": F.min, "max": F.max}
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{m}") for c in cols for m, f in measures.items()])
    moments = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{m}").alias(m) for m in measures]) for c in cols
    ])))
    quartiles = quantile_rows(df, {c: (0.25, 0.5, 0.75) for c in cols})
    return moments.join(quartiles, "column").select(
        "column", "n", round_half_up(F.col("mean"), 4).alias("mean"), round_half_up(F.col("stddev"), 4).alias("stddev"),
        "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max",
    )


def describe_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row for each column, as a describe over all types gives it: numbers get the measures of ``describe``, all
    other types how many distinct values they have, the most frequent one (the least of several) and its count.

    Values of all such columns are counted in one pass, combined before the shuffle; a column's values never meet in one
    task, only counts of them do.
    """
    cols = list(cols or df.columns)
    kinds = dict(df.dtypes)
    numeric = [c for c in cols if kinds[c].startswith(("decimal", "double", "float", "bigint", "int", "smallint", "tinyint"))]
    counts = _melt(df, [c for c in cols if c not in numeric]).where(F.col("value").isNotNull()) if len(numeric) < len(cols) else None
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    found = names
    if counts is not None:
        counted = counts.groupBy("column", "value").agg(F.count("*").alias("k"))
        first = F.min(F.struct((-F.col("k")).alias("less"), "value"))
        texts = counted.groupBy("column").agg(F.sum("k").alias("text_n"), F.count("*").alias("n_unique"), first.alias("first"))
        found = found.join(texts.select("column", "text_n", "n_unique", F.col("first.value").alias("top"), (-F.col("first.less")).alias("freq")), "column", "left")
    else:
        found = found.select("column", *[F.lit(None).cast(t).alias(c) for c, t in (("text_n", "bigint"), ("n_unique", "bigint"), ("top", "string"), ("freq", "bigint"))])
    measures = ("mean", "stddev", "min", "q1", "median", "q3", "max")
    if numeric:
        found = found.join(describe(df, numeric), "column", "left")
    else:
        found = found.select("*", F.lit(None).cast("bigint").alias("n"), *[F.lit(None).cast("double").alias(c) for c in measures])
    return found.select("column", F.coalesce("n", "text_n", F.lit(0)).alias("n"), "n_unique", "top", "freq", *measures)


def dataset_summary(df: DataFrame) -> DataFrame:
    """The report printed after cleaning, as (metric, value) rows, platform counts included."""
    totals = df.agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.countDistinct("track_uri").alias("tracks"),
        F.countDistinct("artist_name").alias("artists"),
        F.sum("ms_played").alias("ms"),
        F.avg(F.col("skipped").cast("double")).alias("skipped"),
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    values = {
        "total_records": whole_text(F.col("n")),
        "date_range": F.concat(day("first_ts"), F.lit(" to "), day("last_ts")),
        "unique_tracks": whole_text(F.col("tracks")),
        "unique_artists": whole_text(F.col("artists")),
        "total_listening_hours": one_decimal_text(round_half_up(F.col("ms") / 3.6e6, 1)),
        "skip_rate": F.concat(one_decimal_text(round_half_up(F.col("skipped") * 1e2, 1)), F.lit("%")),
        "avg_play_duration_seconds": one_decimal_text(round_half_up(F.col("ms") / F.col("n") / 1e3, 1)),
    }
    platforms = df.groupBy("platform").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("platform: "), "platform").alias("metric"), whole_text(F.col("n")).alias("value")
    )
    return unpivot_row(totals, values, "metric", "value").unionByName(platforms)


def audit_trail(raw: DataFrame) -> DataFrame:
    """Rows left after each cleaning step.

    The filters are cumulative conditions on one projection, so one pass counts all steps but
    the last; only the duplicate step needs its own aggregation.
    """
    coerced = raw.transform(cleaning.fill_unknown).transform(cleaning.to_bool).transform(cleaning.clean_text)
    critical = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("track_uri", "ts", "ms_played")])
    number = F.col("ms_played").try_cast("double")
    parsed = F.try_to_timestamp(F.col("ts"), F.lit("dd-MM-yyyy HH:mm")).isNotNull()
    counts = coerced.agg(
        F.count("*").alias("loaded"),
        F.count_if(critical).alias("critical_present"),
        F.count_if(critical & parsed).alias("timestamp_parsed"),
        F.count_if(critical & parsed & (number >= 0)).alias("duration_valid"),
    )
    trail = unpivot_row(counts, {c: F.col(c) for c in counts.columns}, "step", "n_rows")
    final = cleaning.clean(raw).agg(F.count("*").alias("n_rows")).select(F.lit("deduplicated").alias("step"), "n_rows")
    return trail.unionByName(final)


def audit_log(raw: DataFrame) -> DataFrame:
    """What cleaning found and did, as (step, metric, value) rows."""
    rows = audit_trail(raw).select(F.lit("rows").alias("step"), F.col("step").alias("metric"), F.col("n_rows").alias("value"))
    missing = null_profile(raw, RAW_COLUMNS).select(
        F.lit("missing").alias("step"), F.col("column").alias("metric"), F.col("n_missing").alias("value")
    )
    typed = cleaning.typed(raw)
    capped = typed.agg(F.count_if(F.col("ms_played") > MAX_PLAY_MS).alias("value")).select(
        F.lit("outliers").alias("step"), F.lit("capped").alias("metric"), "value"
    )
    kept = typed.transform(cleaning.cap).transform(cleaning.drop_negative)
    duplicates = dup_count(kept).select(
        F.lit("duplicates").alias("step"), F.lit("exact").alias("metric"), F.col("duplicates").alias("value")
    )
    return rows.unionByName(missing).unionByName(capped).unionByName(duplicates)


# What a column name must contain or start with to count for a group.
_NAME_PARTS = {
    "temporal": ("hour", "day", "time", "season", "weekend", "morning", "evening", "night", "peak"),
    "behavioral": ("skip", "completion", "engagement", "listening", "quality"),
    "content": ("track_", "artist_", "album_"),
}
_NAME_STARTS = {"user": "user_", "session": "session_"}


def feature_inventory(df: DataFrame) -> DataFrame:
    """Columns counted by name pattern and by type, read off the schema without a job."""
    names = [c.lower() for c in df.columns]
    rows = [("all", "columns", len(names))]
    rows += [("group", g, sum(any(p in c for p in parts) for c in names)) for g, parts in _NAME_PARTS.items()]
    rows += [("group", g, sum(c.startswith(start) for c in names)) for g, start in _NAME_STARTS.items()]
    types = sorted({t for _, t in df.dtypes})
    rows += [("type", t, sum(t == u for _, u in df.dtypes)) for t in types]
    return df.sparkSession.createDataFrame(rows, "kind string, name string, n_columns bigint")
