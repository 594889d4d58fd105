"""Profiles per entity, track and artist. The log has no listener, so the track stands in by default."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import constants as K
from earshot.functions.numbers import exact_mean, exact_sum, flag, right_closed_bin, round_half_even
from earshot.functions.times import whole_days_between
from earshot.operators.joins import attach, join_on, with_distinct, with_modes

ENTITY = ("track_uri",)


def _skip3() -> Column:
    return round_half_even(F.avg(flag(F.col("is_skip"))), 3)


def entity_stats(plays: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Counts, rates (three digits), favourite platform, lifespan and plays per day."""
    stats = plays.groupBy(*entity).agg(
        F.count("*").alias("play_count"),
        F.min("timestamp").alias("first_play"),
        F.max("timestamp").alias("last_play"),
        _skip3().alias("skip_rate"),
        round_half_even(exact_mean(F.col("percent_played")), 3).alias("avg_completion"),
        round_half_even(exact_mean(F.col("engagement_score")), 3).alias("avg_engagement"),
        round_half_even(F.avg(flag(F.col("shuffle"))), 3).alias("shuffle_rate"),
        round_half_even(F.sum("ms_played") / 1e3, 3).alias("total_seconds"),
    )
    stats = with_modes(stats, plays, entity, {"preferred_platform": "platform"})
    days = whole_days_between(F.col("first_play"), F.col("last_play")) + 1
    return stats.withColumn("lifespan_days", days).withColumn("frequency", F.col("play_count") / F.col("lifespan_days"))


def entity_segment(stats: DataFrame) -> DataFrame:
    n, engaged, skip = F.col("play_count"), F.col("avg_engagement"), F.col("skip_rate")
    segment = (
        F.when((n >= 20) & (engaged >= 0.7), "Power User")
        .when((n >= 10) & (engaged >= 0.5), "Engaged User")
        .when(skip >= 0.6, "At-Risk User")
        .otherwise("Casual User")
    )
    return stats.withColumn("user_segment", segment)


def _prefixed(stats: DataFrame, entity: Sequence[str]) -> DataFrame:
    return stats.select(
        *entity,
        F.col("play_count").alias("user_play_count"),
        F.col("skip_rate").alias("user_skip_rate"),
        F.col("avg_completion").alias("user_avg_completion"),
        F.col("avg_engagement").alias("user_avg_engagement"),
        "user_segment",
        F.col("frequency").alias("user_frequency"),
    )


def entity_features(plays: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """The six entity columns, prefixed for joining to plays."""
    return _prefixed(plays.transform(entity_stats, entity).transform(entity_segment), entity)


def track_stats(plays: DataFrame) -> DataFrame:
    return plays.groupBy("track_name", "artist_name").agg(
        F.count("*").alias("track_play_count"),
        _skip3().alias("track_skip_rate"),
        round_half_even(exact_mean(F.col("percent_played")), 3).alias("track_avg_completion"),
        round_half_even(exact_mean(F.col("engagement_score")), 3).alias("track_avg_engagement"),
    )


def artist_stats(plays: DataFrame) -> DataFrame:
    return plays.groupBy("artist_name").agg(
        F.count("*").alias("artist_play_count"),
        F.countDistinct("track_name").alias("artist_unique_tracks"),
        _skip3().alias("artist_skip_rate"),
        round_half_even(exact_mean(F.col("engagement_score")), 3).alias("artist_avg_engagement"),
    )


#: What a play is of.
CONTENT = ("track_uri", "track_name", "artist_name")


def content_rollup(plays: DataFrame) -> DataFrame:
    """Sums per (uri, track, artist), from which entity, track and artist features add up.

    One pass over the log instead of one per table; small once staged.
    """
    return plays.groupBy(*CONTENT).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("is_skip")).alias("skips"),
        exact_sum(F.col("percent_played")).alias("percent_sum"),
        exact_sum(F.col("engagement_score")).alias("engagement_sum"),
        F.min("timestamp").alias("first_play"),
        F.max("timestamp").alias("last_play"),
    )


def _rolled_mean(total: str) -> Column:
    """Three-digit mean of a ``content_rollup`` sum."""
    return round_half_even(F.sum(total).cast("double") / 1e9 / F.sum("n"), 3)


def _rolled_skip() -> Column:
    return round_half_even(F.sum("skips") / F.sum("n"), 3)


def rolled_entities(rollup: DataFrame) -> DataFrame:
    """``entity_features`` per uri, from a rollup."""
    days = whole_days_between(F.min("first_play"), F.max("last_play")) + 1
    stats = rollup.groupBy("track_uri").agg(
        F.sum("n").alias("play_count"),
        _rolled_skip().alias("skip_rate"),
        _rolled_mean("percent_sum").alias("avg_completion"),
        _rolled_mean("engagement_sum").alias("avg_engagement"),
        (F.sum("n") / days).alias("frequency"),
    )
    return _prefixed(entity_segment(stats), ENTITY)


def rolled_tracks(rollup: DataFrame) -> DataFrame:
    """``track_stats`` from a rollup."""
    return rollup.groupBy("track_name", "artist_name").agg(
        F.sum("n").alias("track_play_count"),
        _rolled_skip().alias("track_skip_rate"),
        _rolled_mean("percent_sum").alias("track_avg_completion"),
        _rolled_mean("engagement_sum").alias("track_avg_engagement"),
    )


def rolled_artists(rollup: DataFrame) -> DataFrame:
    """``artist_stats`` from a rollup."""
    return rollup.groupBy("artist_name").agg(
        F.sum("n").alias("artist_play_count"),
        F.countDistinct("track_name").alias("artist_unique_tracks"),
        _rolled_skip().alias("artist_skip_rate"),
        _rolled_mean("engagement_sum").alias("artist_avg_engagement"),
    )


def content_table(rollup: DataFrame, by_entity: DataFrame, by_track: DataFrame, by_artist: DataFrame) -> DataFrame:
    """Entity, track and artist features for each key of a rollup, so that events meet them all in one join."""
    keys = rollup.select(*CONTENT)
    return join_on(join_on(join_on(keys, by_entity, ENTITY), by_track, CONTENT[1:]), by_artist, CONTENT[2:])


def popularity(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "track_popularity": right_closed_bin(F.col("track_play_count"), K.TRACK_BINS),
        "artist_popularity": right_closed_bin(F.col("artist_play_count"), K.ARTIST_BINS),
    })


def content_stats(plays: DataFrame) -> DataFrame:
    """Track rows with their artist's numbers and both popularity classes."""
    return track_stats(plays).join(artist_stats(plays), "artist_name").transform(popularity)


def attach_content(plays: DataFrame) -> DataFrame:
    """Plays with track and artist numbers and popularity classes."""
    with_track = attach(plays, track_stats(plays), ["track_name", "artist_name"], "track_stats")
    return attach(with_track, artist_stats(plays), ["artist_name"], "artist_stats").transform(popularity)


def cluster_profile(sessions: DataFrame, entity: Sequence[str] = ENTITY, min_plays: int = 5) -> DataFrame:
    """The model script's entity profile: 12 aggregates and 3 ratios."""
    grouped = sessions.groupBy(*entity).agg(
        F.count("*").alias("total_plays"),
        round_half_even(F.sum("ms_played") / 1e3, 3).alias("total_seconds"),
        round_half_even(F.sum("ms_played") / 1e3 / F.count("*"), 3).alias("avg_seconds_per_play"),
        _skip3().alias("skip_rate"),
        round_half_even(exact_mean(F.col("percent_played")), 3).alias("avg_completion"),
        round_half_even(exact_mean(F.col("engagement_score")), 3).alias("avg_engagement"),
        round_half_even(F.avg(flag(F.col("shuffle"))), 3).alias("shuffle_rate"),
    ).where(F.col("total_plays") >= min_plays)
    grouped = with_modes(grouped, sessions, entity, {"preferred_platform": "platform", "preferred_time": "time_of_day"})
    grouped = with_distinct(
        grouped, sessions, entity, {"total_sessions": "session_id", "artist_diversity": "artist_name", "track_diversity": "track_name"}
    )
    return grouped.withColumn("total_minutes", F.col("total_seconds") / 60).withColumns({
        "avg_session_length": F.col("total_plays") / F.col("total_sessions"),
        "listening_intensity": F.col("total_minutes") / F.col("total_sessions"),
    })


def entity_profile(plays: DataFrame, entity: Sequence[str] = ENTITY, min_plays: int = 3) -> DataFrame:
    """The notebook's entity profile, with completion discounted by skips as engagement."""
    grouped = plays.groupBy(*entity).agg(
        F.count("*").alias("play_count"),
        round_half_even(F.sum("ms_played") / 1e3, 3).alias("total_seconds"),
        round_half_even(F.sum("ms_played") / 1e3 / F.count("*"), 3).alias("avg_seconds_per_play"),
        _skip3().alias("skip_rate"),
        round_half_even(exact_mean(F.col("percent_played")), 3).alias("avg_percent_played"),
        round_half_even(F.avg(flag(F.col("shuffle"))), 3).alias("shuffle_rate"),
        round_half_even(F.avg("day_of_week_num"), 3).alias("avg_day_of_week"),
    ).where(F.col("play_count") >= min_plays)
    grouped = with_modes(grouped, plays, entity, {"preferred_hour": "hour_of_day", "preferred_platform": "platform"})
    return grouped.withColumns({
        "total_minutes": F.col("total_seconds") / 60,
        "engagement_score": F.col("avg_percent_played") * (1 - F.col("skip_rate")),
    })
