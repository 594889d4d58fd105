"""Plays over hours, weekdays, days, weeks and months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot import constants as K
from earshot.functions.numbers import flag, round_half_even, round_half_up
from earshot.functions.times import week_start
from earshot.operators import trends
from earshot.operators.joins import share_of_total
from earshot.plans import measures as m


def hourly(plays: DataFrame) -> DataFrame:
    return plays.groupBy("hour_of_day").agg(
        m.plays().alias("total_plays"),
        m.hours().alias("total_hours"),
        m.skip_pct().alias("skip_rate_pct"),
        m.completion().alias("avg_percent_played"),
    ).orderBy("hour_of_day")


def weekday(plays: DataFrame) -> DataFrame:
    return (
        plays.groupBy("day_of_week", "day_of_week_num")
        .agg(
            m.plays().alias("total_plays"),
            m.hours().alias("total_hours"),
            m.avg_seconds().alias("avg_seconds_per_play"),
            m.skip_pct().alias("skip_rate_pct"),
        )
        .orderBy("day_of_week_num")
        .drop("day_of_week_num")
    )


def count_by(plays: DataFrame, key: str) -> DataFrame:
    return plays.groupBy(key).agg(m.plays().alias("plays")).orderBy(key)


def monthly(plays: DataFrame) -> DataFrame:
    return count_by(plays, "month")


def by_time(plays: DataFrame) -> DataFrame:
    return count_by(plays, "time_of_day")


def daily(plays: DataFrame) -> DataFrame:
    return plays.groupBy("date").agg(
        m.plays().alias("daily_plays"),
        F.countDistinct("track_uri").alias("unique_tracks"),
        m.hours().alias("daily_hours"),
        m.avg_seconds().alias("avg_seconds_per_play"),
        m.skip_pct().alias("daily_skip_rate"),
    ).orderBy("date")


def daily_activity(plays: DataFrame) -> DataFrame:
    """Unrounded hours and minutes per day, for the retention measures."""
    return plays.groupBy("date").agg(
        m.plays().alias("daily_plays"),
        (F.sum("ms_played") / 3.6e6).alias("daily_hours"),
        (F.sum("ms_played") / 6e4).alias("daily_minutes"),
        m.skip_rate3().alias("daily_skip_rate"),
    )


def weekly(plays: DataFrame) -> DataFrame:
    """By week start, so weeks of different years stay apart."""
    by_week = plays.groupBy(week_start(F.col("timestamp")).alias("week")).agg(
        m.plays().alias("weekly_plays"),
        F.sum("ms_played").alias("ms"),
        F.countDistinct("date").alias("active_days"),
    )
    return by_week.select(
        "week", "weekly_plays", round_half_even(F.col("ms") / 1e3, 3).alias("weekly_seconds"),
        (F.col("ms") / 3.6e6).alias("weekly_hours"), "active_days",
    ).orderBy("week")


def weekly_from_daily(plays: DataFrame) -> DataFrame:
    """Weeks summed up from days, with daily means."""
    days = daily_activity(plays).withColumn("week", F.to_date(F.date_trunc("week", F.col("date").cast("timestamp"))))
    return days.groupBy("week").agg(
        F.count("*").alias("active_days_per_week"),
        F.sum("daily_plays").alias("total_weekly_plays"),
        round_half_even(F.avg("daily_plays"), 2).alias("avg_daily_plays"),
        round_half_even(F.sum("daily_minutes"), 2).alias("total_weekly_minutes"),
        round_half_even(F.avg("daily_minutes"), 2).alias("avg_daily_minutes"),
        round_half_even(F.avg("daily_skip_rate"), 2).alias("avg_weekly_skip_rate"),
    ).orderBy("week")


def quality_distribution(plays: DataFrame) -> DataFrame:
    table = plays.groupBy("listening_quality").agg(
        m.plays().alias("plays"), m.avg_seconds().alias("avg_seconds"), m.completion().alias("avg_percent_played")
    )
    place = F.when(F.col("listening_quality") == "High", 1).when(F.col("listening_quality") == "Medium", 2).otherwise(3)
    return share_of_total(table, "plays", "share").select(
        "listening_quality", "plays", round_half_up(F.col("share"), 1).alias("percentage"), "avg_seconds", "avg_percent_played"
    ).orderBy(place)


def rolling_report(plays: DataFrame) -> DataFrame:
    """Daily metrics with 7-row means and the change against a week (7 rows) before."""
    days = daily(plays).select("date", "daily_plays", "daily_hours", "daily_skip_rate")
    rolled = trends.trailing_avg(days, {
        "daily_plays": "rolling_7d_plays", "daily_hours": "rolling_7d_hours", "daily_skip_rate": "rolling_7d_skip_rate",
    })
    return trends.pct_change(rolled, "daily_plays", 7, "wow_plays_growth").orderBy("date")


def centred_report(plays: DataFrame) -> DataFrame:
    """Daily plays and hours smoothed over seven days around each day."""
    return trends.centred_avg(
        daily_activity(plays).select("date", "daily_plays", "daily_hours"),
        {"daily_plays": "rolling_plays", "daily_hours": "rolling_hours"}, digits=4,
    )


def retention_table(plays: DataFrame) -> DataFrame:
    """Days with their week and seven-day centred means, as exported by the retention step."""
    days = daily_activity(plays).select(
        "date", "daily_plays", "daily_minutes", "daily_skip_rate",
        F.to_date(F.date_trunc("week", F.col("date").cast("timestamp"))).alias("week"),
    )
    return trends.centred_avg(days, {"daily_plays": "rolling_7d_plays", "daily_minutes": "rolling_7d_minutes"}, digits=4)


def peak_report(plays: DataFrame) -> DataFrame:
    """Busiest and quietest hour, weekday and platform, and the hours with most and fewest skips."""
    def counted(key: str) -> DataFrame:
        return trends.peaks(plays.groupBy(key).agg(m.plays().alias("n")), key, "n").withColumns(
            {"peak": F.col("peak").cast("double"), "low": F.col("low").cast("double")}
        )

    hour, day, platform = (counted(k).withColumn("measure", F.lit(f"plays by {k}")) for k in ("hour_of_day", "day_of_week", "platform"))
    rates = plays.groupBy("hour_of_day").agg(m.skip_rate3().alias("rate"))
    skip = trends.peaks(rates, "hour_of_day", "rate").withColumn("measure", F.lit("skip rate by hour_of_day"))
    return hour.unionByName(day).unionByName(platform).unionByName(skip).select(
        "measure", "peak_key", "peak", "low_key", "low", "ratio"
    )


def overview(plays: DataFrame) -> DataFrame:
    """Dashboard cards; the skip rate here is the player's own flag."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return plays.agg(
        m.plays().alias("plays"),
        m.hours().alias("hours"),
        F.countDistinct("track_name").alias("tracks"),
        F.countDistinct("artist_name").alias("artists"),
        round_half_up(F.avg(flag(F.col("skipped"))) * 1e2, 1).alias("raw_skip_rate"),
        m.avg_seconds().alias("avg_seconds"),
        F.concat(day(F.min("timestamp")), F.lit(" to "), day(F.max("timestamp"))).alias("date_range"),
        F.floor((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 8.64e10).cast("bigint").alias("span_days"),
    )


HEATMAP_HOURS = tuple(range(24))
DAY_PARTS = K.DAY_PARTS
