"""Platforms: comparison, shares, engagement, rollups and switching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.functions.numbers import flag, round_half_even, round_half_up
from earshot.operators.joins import normalise_by_max, share_of_total
from earshot.operators.ordered import OrderedLog, previous
from earshot.plans import measures as m


def platform_report(plays: DataFrame) -> DataFrame:
    table = plays.groupBy("platform").agg(
        m.plays().alias("total_plays"),
        m.hours().alias("total_hours"),
        m.avg_seconds().alias("avg_seconds_per_play"),
        m.skip_pct().alias("skip_rate_pct"),
        m.completion().alias("avg_percent_played"),
    )
    share = share_of_total(table, "total_plays", "share")
    return share.select(
        "platform",
        "total_plays",
        round_half_up(F.col("share"), 1).alias("market_share_pct"),
        "total_hours",
        "avg_seconds_per_play",
        "skip_rate_pct",
        "avg_percent_played",
    ).orderBy(F.desc("total_plays"), "platform")


def platform_by_time(plays: DataFrame) -> DataFrame:
    table = plays.groupBy("time_of_day", "platform").agg(m.plays().alias("plays"))
    return (
        share_of_total(table, "plays", "share", ["time_of_day"])
        .select("time_of_day", "platform", "plays", round_half_up(F.col("share"), 1).alias("platform_share_pct"))
        .orderBy("time_of_day", F.desc("plays"), "platform")
    )


def platform_table(plays: DataFrame) -> DataFrame:
    return plays.groupBy("platform").agg(
        m.plays().alias("total_plays"),
        round_half_even(F.sum("ms_played") / 1e3, 3).alias("total_seconds"),
        round_half_even(F.sum("ms_played") / 1e3 / F.count("*"), 3).alias("avg_seconds_per_play"),
        m.skip_rate3().alias("skip_rate"),
        m.completion3().alias("avg_percent_played"),
        m.shuffle_rate3().alias("shuffle_rate"),
    )


def platform_engagement(plays: DataFrame) -> DataFrame:
    """Score 0-100 against the best platform in completion, skips and play time."""
    table = platform_table(plays).withColumn("kept", 1 - F.col("skip_rate"))
    scored = normalise_by_max(table, ["avg_percent_played", "kept", "avg_seconds_per_play"])
    score = (F.col("avg_percent_played_norm") * 0.4 + F.col("kept_norm") * 0.4 + F.col("avg_seconds_per_play_norm") * 0.2) * 100
    # one row per platform reaches this window
    ranks = F.row_number().over(Window.orderBy(F.desc("engagement_score"), "platform"))
    return scored.select("platform", score.alias("engagement_score")).withColumn("rank", ranks)



def _grouped(groups, dims: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """Subtotals are labelled by the grouping bit, so a real null keeps its own row."""
    first, second = dims
    table = groups.agg(
        F.grouping(first).alias("_g1"),
        F.grouping(second).alias("_g2"),
        m.plays().alias("total_plays"),
        m.hours().alias("total_hours"),
        m.skip_pct().alias("skip_rate_pct"),
        m.completion().alias("avg_percent_played"),
    )
    return table.select(
        F.when(F.col("_g1") == 1, names[0]).otherwise(F.col(first)).alias(first),
        F.when(F.col("_g2") == 1, names[1]).otherwise(F.col(second)).alias(second),
        "total_plays",
        "total_hours",
        "skip_rate_pct",
        "avg_percent_played",
    ).orderBy(F.col(first).asc_nulls_last(), F.col(second).asc_nulls_last())


DIMS = ("platform", "time_of_day")
DIM_LABELS = ("ALL PLATFORMS", "ALL TIMES")


def rollup_report(plays: DataFrame, dims: tuple[str, str] = DIMS, names: tuple[str, str] = DIM_LABELS) -> DataFrame:
    return _grouped(plays.rollup(*dims), dims, names)


def cube_report(plays: DataFrame, dims: tuple[str, str] = DIMS, names: tuple[str, str] = DIM_LABELS) -> DataFrame:
    return _grouped(plays.cube(*dims), dims, names)


def switch_rate(log: OrderedLog) -> DataFrame:
    """Share of plays on another platform than the play before; the first play counts as a switch."""
    seen = log.history({"prev_platform": previous("platform")}, reach=1)
    same = F.coalesce(F.col("platform") == F.col("prev_platform"), F.lit(False))
    return seen.agg(round_half_up(F.avg(flag(~same)), 6).alias("rate"))
