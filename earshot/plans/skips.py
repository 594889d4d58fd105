"""What goes with skipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot import constants as K
from earshot.functions.numbers import exact_mean, flag, ratio, round_half_even, round_half_up, round_signed
from earshot.operators.features import top_categories
from earshot.operators.quality import unpivot_row
from earshot.plans import measures as m

# Report label -> column, in the order of the grouping bits below.
DIMENSIONS = {"Platform": "platform", "Time of Day": "time_of_day", "Shuffle Mode": "shuffle"}


def skip_by_dimension(plays: DataFrame, dims: dict[str, str] | None = None) -> DataFrame:
    """Overall and per dimension in one scan: grouping sets instead of one query per dimension."""
    dims = dims or DIMENSIONS
    cols = list(dims.values())
    sets = [[], *[[c] for c in cols]]
    table = plays.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("_gid"),
        m.plays().alias("total_plays"),
        m.skips().alias("skips"),
        m.skip_pct().alias("skip_rate_pct"),
    )
    everything = (1 << len(cols)) - 1
    name, value = F.when(F.col("_gid") == everything, "Overall"), F.when(F.col("_gid") == everything, "All")
    for i, (label, c) in enumerate(dims.items()):
        only = F.col("_gid") == everything - (1 << (len(cols) - 1 - i))
        text = F.when(F.col(c), "Shuffle On").otherwise("Shuffle Off") if c == "shuffle" else F.col(c).cast("string")
        name, value = name.when(only, label), value.when(only, text)
    return table.select(
        name.alias("dimension"), value.alias("category"), "total_plays", "skips", "skip_rate_pct"
    ).orderBy("dimension", F.desc("skip_rate_pct"), "category")


def skip_summary(plays: DataFrame) -> DataFrame:
    pct = F.col("percent_played")
    return plays.agg(
        m.plays().alias("total"),
        m.skips().alias("skipped"),
        m.skip_pct().alias("skip_rate"),
        m.completion().alias("avg_pct_all"),
        round_half_up(exact_mean(F.when(~F.col("is_skip"), pct)), 1).alias("avg_pct_non_skip"),
        round_half_up(exact_mean(F.when(F.col("is_skip"), pct)), 1).alias("avg_pct_skip"),
    )


def skip_by_reason_end(plays: DataFrame) -> DataFrame:
    return plays.groupBy("reason_end").agg(
        m.plays().alias("plays"), m.skip_pct(1).alias("skip_rate")
    ).orderBy(F.desc("skip_rate"), "reason_end")


def journey_matrix(plays: DataFrame, min_count: int = 100, k: int = 10) -> DataFrame:
    return (
        plays.groupBy("reason_start", "reason_end")
        .agg(m.plays().alias("count"), m.skip_rate3().alias("skip_rate"), m.completion3().alias("avg_percent_played"))
        .where(F.col("count") >= min_count)
        .orderBy(F.desc("count"), "reason_start", "reason_end")
        .limit(k)
    )


def discovery(plays: DataFrame) -> DataFrame:
    return plays.groupBy("reason_start").agg(
        m.plays().alias("count"), m.skip_rate3().alias("skip_rate"), m.completion3().alias("avg_percent_played")
    ).orderBy(F.desc("count"), "reason_start")


def length_vs_skip(plays: DataFrame) -> DataFrame:
    """All length classes, also those without plays."""
    classes = plays.sparkSession.createDataFrame([(label,) for _, label in K.LENGTH_BINS], "track_length_category string")
    table = plays.groupBy("track_length_category").agg(
        m.skip_rate3().alias("skip_rate"), m.plays().alias("count"), m.completion3().alias("avg_percent_played")
    )
    return classes.join(table, "track_length_category", "left").na.fill(0, subset=["count"])


def raw_skip_by(plays: DataFrame, key: str) -> DataFrame:
    """By the player's own flag, per platform or hour."""
    return plays.groupBy(key).agg(
        m.plays().alias("total_plays"),
        F.count_if(F.col("skipped")).alias("skips"),
        round_half_up(F.avg(flag(F.col("skipped"))) * 1e2, 1).alias("skip_rate"),
    ).orderBy(key)


def skip_correlations(plays: DataFrame, min_abs: float = 0.01, digits: int = 6) -> DataFrame:
    """Pearson correlation of simple features with skipping, strongest first, one aggregation.

    A constant feature has no correlation and is left out.
    """
    features = {c: F.col(c).cast("double") for c in ("hour_of_day", "day_of_week_num", "estimated_track_length_ms")}
    features["shuffle"] = flag(F.col("shuffle"))
    features |= {f"platform_{p}": flag(F.col("platform") == p) for p in top_categories(plays, "platform")}
    y = flag(F.col("is_skip"))
    row = plays.agg(*[
        ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(name) for name, x in features.items()
    ])
    table = unpivot_row(row, {name: F.col(f"`{name}`") for name in features}, "feature", "corr")
    return (
        table.where(F.abs("corr") > min_abs)
        .select("feature", round_signed(F.col("corr"), digits).alias("corr"))
        .orderBy(F.desc(F.abs("corr")), "feature")
    )


def skip_drivers(plays: DataFrame) -> DataFrame:
    """Skip rate by platform, part of day, shuffle and weekday as one table, one scan."""
    dims = {"Platform": "platform", "Time of Day": "time_of_day", "Shuffle Mode": "shuffle", "Day of Week": "day_of_week"}
    return skip_by_dimension(plays, dims).where(F.col("dimension") != "Overall")


def skip_rate_by(plays: DataFrame, key: str) -> DataFrame:
    return plays.groupBy(key).agg(round_half_even(F.avg(flag(F.col("is_skip"))), 4).alias("skip_rate"))
