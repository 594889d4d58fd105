"""Reports over the session tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.functions.numbers import equal_width_bin, exact_mean, flag, round_half_up, round_signed
from earshot.operators import sessions as S
from earshot.operators import trends
from earshot.operators.joins import one_row, share_of_total
from earshot.operators.quantiles import exact_quantiles
from earshot.plans import measures as m


def _avg(col: str, digits: int = 1) -> Column:
    """Mean of one-decimal values; tenths are summed as integers, exact in any order of rows."""
    return round_half_up(F.sum(F.rint(F.col(col) * 10.0).cast("bigint")) / 10.0 / F.count(col), digits)


def _high_pct() -> Column:
    return F.avg(flag(F.col("session_quality") == "High Quality")) * 1e2


def session_quality_report(metrics: DataFrame) -> DataFrame:
    table = metrics.groupBy("session_quality").agg(
        F.count("*").alias("session_count"),
        _avg("tracks_count").alias("avg_tracks"),
        _avg("session_duration_minutes").alias("avg_duration_min"),
        _avg("session_skip_rate").alias("avg_skip_rate"),
        _avg("total_listening_minutes").alias("avg_listening_min"),
    )
    place = (
        F.when(F.col("session_quality") == "High Quality", 1).when(F.col("session_quality") == "Medium Quality", 2).otherwise(3)
    )
    return share_of_total(table, "session_count", "share").select(
        "session_quality", "session_count", round_half_up(F.col("share"), 1).alias("percentage"),
        "avg_tracks", "avg_duration_min", "avg_skip_rate", "avg_listening_min",
    ).orderBy(place)


def session_platform_report(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("primary_platform").agg(
        F.count("*").alias("session_count"),
        _avg("tracks_count").alias("avg_tracks_per_session"),
        _avg("session_duration_minutes").alias("avg_session_duration"),
        _avg("session_skip_rate").alias("avg_skip_rate"),
        _avg("total_listening_minutes").alias("avg_listening_time"),
        _avg("listening_efficiency").alias("avg_listening_efficiency"),
        _high_pct().alias("high_quality_pct"),
    ).orderBy(F.desc("session_count"), "primary_platform")


def session_time_report(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("session_time_period", "session_start_hour").agg(
        F.count("*").alias("session_count"),
        _avg("tracks_count").alias("avg_tracks"),
        _avg("session_duration_minutes").alias("avg_duration"),
        _avg("session_skip_rate").alias("avg_skip_rate"),
        round_half_up(_high_pct(), 1).alias("high_quality_pct"),
    ).orderBy("session_start_hour")


def session_journey(sessions: DataFrame, first: int = 10, tiebreak: str = "event_id") -> DataFrame:
    """How plays go by position in the session, for the first positions."""
    table = S.position(sessions, first, tiebreak).groupBy(F.col("track_position_in_session").alias("track_position")).agg(
        F.count("*").alias("total_occurrences"),
        m.skip_pct().alias("skip_rate_by_position"),
        m.completion().alias("avg_completion_by_position"),
        F.mode("reason_start", True).alias("common_start_reason"),
        F.mode("reason_end", True).alias("common_end_reason"),
    )
    return trends.delta(table, "skip_rate_by_position", "track_position", "skip_rate_change").orderBy("track_position")


def session_segments(metrics: DataFrame) -> DataFrame:
    """Segments by session behaviour, the main platform standing in for the listener."""
    table = metrics.groupBy(F.col("primary_platform").alias("user_platform")).agg(
        F.count("*").alias("total_sessions"),
        _avg("tracks_count").alias("avg_tracks_per_session"),
        _avg("session_duration_minutes").alias("avg_session_duration"),
        _avg("session_skip_rate").alias("avg_session_skip_rate"),
        _high_pct().alias("high_quality_session_pct"),
        F.mode("session_time_period", True).alias("preferred_time_period"),
    )
    n, high, skip = F.col("total_sessions"), F.col("high_quality_session_pct"), F.col("avg_session_skip_rate")
    segment = (
        F.when((n >= 50) & (high >= 60), "Power User")
        .when((n >= 20) & (high >= 40), "Engaged User")
        .when((n >= 10) & (skip <= 40), "Casual User")
        .when(skip > 60, "At-Risk User")
        .otherwise("New/Light User")
    )
    return table.withColumn("user_segment", segment).orderBy(F.desc("total_sessions"), "user_platform")


def daily_sessions(metrics: DataFrame, per_platform: bool = False) -> DataFrame:
    """Sessions per day and platform with the change to the row before and a 7-row mean.

    Rows follow (date, platform); ``per_platform`` keeps the platforms' series apart.
    """
    table = metrics.groupBy(F.to_date("session_start").alias("session_date"), "primary_platform").agg(
        F.count("*").alias("daily_session_count"),
        _avg("session_duration_minutes").alias("avg_daily_session_duration"),
        _avg("session_skip_rate").alias("avg_daily_skip_rate"),
    )
    # one row per day and platform: calendar-bounded
    w = (
        Window.partitionBy("primary_platform").orderBy("session_date")
        if per_platform
        else Window.orderBy("session_date", "primary_platform")
    )
    n, before = F.col("daily_session_count"), F.col("prev_day_sessions")
    return (
        table.withColumn("prev_day_sessions", F.lag("daily_session_count").over(w))
        .withColumn("dod_session_change", round_signed((n - before) * 1e2 / F.nullif(before, F.lit(0)), 1))
        .withColumn("rolling_7d_sessions", round_half_up(F.avg("daily_session_count").over(w.rowsBetween(-6, 0)), 1))
        .orderBy("session_date", "primary_platform")
    )


def session_summary(stats: DataFrame) -> DataFrame:
    """Averages and medians of duration, plays and skip rate, and sessions per active day."""
    row = stats.agg(
        F.count("*").alias("sessions"),
        round_half_up(F.sum("tracks_count") / F.count("*"), 4).alias("tracks_per_session"),
        _avg("session_duration_minutes", 4).alias("avg_duration"),
        round_half_up(F.avg("skip_rate"), 4).alias("avg_skip_rate"),
        round_half_up(F.count("*") / F.countDistinct(F.to_date("session_start")), 4).alias("daily_sessions"),
    )
    medians = {"median_duration": "session_duration_minutes", "median_tracks": "tracks_count", "median_skip_rate": "skip_rate"}
    found = exact_quantiles(stats, {c: (0.5,) for c in medians.values()})
    return row.withColumns({name: F.lit(found[c][0]).cast("double") for name, c in medians.items()})


def score_shares(scored: DataFrame) -> DataFrame:
    """Share of each score class; unclassed sessions do not count."""
    table = scored.where(F.col("quality_category").isNotNull()).groupBy("quality_category").agg(F.count("*").alias("n"))
    return share_of_total(table, "n", "pct").select("quality_category", "n", round_half_up(F.col("pct"), 4).alias("pct"))


def score_by_platform(scored: DataFrame) -> DataFrame:
    return scored.groupBy("primary_platform").agg(round_half_up(exact_mean(F.col("session_quality_score")), 4).alias("avg_score"))


def histogram(table: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value, empty bins included."""
    x = F.col(col).cast("double")
    edges = one_row(table.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    counted = (
        table.where(x.isNotNull())
        .withColumn("bin", equal_width_bin(x, edges["lo"], edges["hi"], bins))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    width = (edges["hi"] - edges["lo"]) / float(bins)
    grid = table.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        round_signed(edges["lo"] + width * F.col("id"), 6).alias("lo"),
        round_signed(edges["lo"] + width * (F.col("id") + 1), 6).alias("hi"),
    )
    return grid.join(counted, "bin", "left").na.fill(0, subset=["n"]).orderBy("bin")


def session_events(sessions: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The event export of the session step."""
    return sessions.select(
        "session_id", "timestamp", "track_uri", "platform", "seconds_played", "is_skip", "time_of_day", "day_of_week", *keep
    )
