"""Tracks and artists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.functions.numbers import exact_mean, flag, round_half_even, round_half_up
from earshot.operators.joins import normalise_by_max
from earshot.operators.ranking import Rank, add_ntile, add_rank_columns
from earshot.plans import measures as m



def top_tracks(plays: DataFrame, min_plays: int = 5, k: int = 20) -> DataFrame:
    return (
        plays.groupBy("track_name", "artist_name")
        .agg(
            m.plays().alias("play_count"),
            m.minutes().alias("total_minutes"),
            m.completion().alias("avg_percent_played"),
            m.skip_pct().alias("skip_rate_pct"),
        )
        .where(F.col("play_count") >= min_plays)
        .orderBy(F.desc("play_count"), "track_name", "artist_name")
        .limit(k)
    )


def artist_totals(plays: DataFrame, min_plays: int = 10) -> DataFrame:
    return (
        plays.groupBy("artist_name")
        .agg(
            m.plays().alias("total_plays"),
            F.countDistinct("track_name").alias("unique_tracks"),
            m.hours().alias("total_hours"),
            m.avg_seconds().alias("avg_seconds_per_play"),
            m.skip_pct().alias("skip_rate_pct"),
            m.completion().alias("avg_percent_played"),
        )
        .where(F.col("total_plays") >= min_plays)
    )


def top_artists(plays: DataFrame, min_plays: int = 10, k: int = 15) -> DataFrame:
    return (
        artist_totals(plays, min_plays)
        .drop("avg_percent_played")
        .orderBy(F.desc("total_hours"), "artist_name")
        .limit(k)
    )


def most_skipped_tracks(plays: DataFrame, min_plays: int = 10, k: int = 15) -> DataFrame:
    return (
        plays.groupBy("track_name", "artist_name")
        .agg(
            m.plays().alias("total_plays"),
            m.skips().alias("total_skips"),
            m.skip_pct().alias("skip_rate_pct"),
            m.completion().alias("avg_percent_played"),
        )
        .where(F.col("total_plays") >= min_plays)
        .orderBy(F.desc("skip_rate_pct"), F.desc("total_plays"), "track_name", "artist_name")
        .limit(k)
    )


def skip_extremes(plays: DataFrame, key: str = "artist_name", min_plays: int = 10, k: int = 10, ascending: bool = False) -> DataFrame:
    """The ``k`` most (or least) skipped values of ``key``."""
    rate = F.col("skip_rate")
    return (
        plays.groupBy(key)
        .agg(m.plays().alias("total_plays"), m.skips().alias("total_skips"), m.skip_rate3().alias("skip_rate"))
        .where(F.col("total_plays") >= min_plays)
        .orderBy(rate.asc() if ascending else rate.desc(), key)
        .limit(k)
    )


def artist_performance(plays: DataFrame, min_plays: int = 20) -> DataFrame:
    """Artists with an engagement score against the best artist in completion, skips and plays."""
    table = (
        plays.groupBy("artist_name")
        .agg(
            m.plays().alias("total_plays"),
            F.countDistinct("track_name").alias("unique_tracks"),
            round_half_even(F.sum("ms_played") / 1e3, 3).alias("total_seconds"),
            m.skip_rate3().alias("skip_rate"),
            m.completion3().alias("avg_percent_played"),
            m.shuffle_rate3().alias("shuffle_rate"),
        )
        .where(F.col("total_plays") >= min_plays)
        .withColumn("total_hours", F.col("total_seconds") / 3600)
        .withColumn("kept", 1 - F.col("skip_rate"))
    )
    names = table.drop("kept").columns
    scored = normalise_by_max(table, ["avg_percent_played", "kept", "total_plays"])
    score = (F.col("avg_percent_played_norm") * 0.4 + F.col("kept_norm") * 0.4 + F.col("total_plays_norm") * 0.2) * 100
    return scored.select(*names, score.alias("engagement_score"))


_RANKS = {
    "plays_rank": Rank("total_plays", ascending=False),
    "plays_share": Rank("total_plays", percent=True),
    "hours_rank": Rank("total_hours", ascending=False),
    "engagement_rank": Rank("skip_rate_pct"),
    "skip_share": Rank("skip_rate_pct", ascending=False, percent=True),
    "completion_share": Rank("avg_percent_played", percent=True),
}


def artist_ranking(plays: DataFrame, min_plays: int = 10, k: int = 20) -> DataFrame:
    """Ranks, quintiles and a composite score of artists; the ``k`` best by score.

    The artist table is sorted into an index once; ranks come from counts of values in a second one.
    """
    artists = add_ntile(artist_totals(plays, min_plays), 5, ["total_plays", "artist_name"], "plays_quintile")
    ranked = add_rank_columns(artists, _RANKS)
    score = F.col("plays_share") * 0.3 + F.col("completion_share") * 0.4 + F.col("skip_share") * 0.3
    return (
        ranked.select(
            "artist_name",
            "total_plays",
            "plays_rank",
            "plays_quintile",
            "total_hours",
            "hours_rank",
            "skip_rate_pct",
            "engagement_rank",
            round_half_up(F.col("skip_share") * 1e2, 1).alias("skip_rate_percentile"),
            "unique_tracks",
            round_half_up(score * 1e2, 1).alias("engagement_score"),
        )
        .orderBy(F.desc("engagement_score"), "artist_name")
        .limit(k)
    )


def listening_time_leaders(plays: DataFrame, k: int = 15) -> DataFrame:
    """Tracks by total minutes, as exported by the exploratory report."""
    return (
        plays.groupBy("track_name", "artist_name")
        .agg(
            m.plays().alias("play_count"),
            round_half_even(F.sum("ms_played") / 1e3, 2).alias("total_seconds"),
            round_half_even(F.avg(flag(F.col("is_skip"))), 2).alias("skip_rate"),
            round_half_even(exact_mean(F.col("percent_played")), 2).alias("avg_percent_played"),
            round_half_even(F.sum("ms_played") / 6e4, 1).alias("total_minutes"),
        )
        .orderBy(F.desc("total_minutes"), "track_name", "artist_name")
        .limit(k)
    )


def artist_leaders(plays: DataFrame, by: str = "total_plays", k: int = 15) -> DataFrame:
    """Artists by plays or by hours, as exported by the exploratory report."""
    return (
        plays.groupBy("artist_name")
        .agg(
            m.plays().alias("total_plays"),
            F.countDistinct("track_name").alias("unique_tracks"),
            round_half_even(F.sum("ms_played") / 1e3, 2).alias("total_seconds"),
            round_half_even(F.avg(flag(F.col("is_skip"))), 2).alias("skip_rate"),
            round_half_even(exact_mean(F.col("percent_played")), 2).alias("avg_percent_played"),
            round_half_even(F.sum("ms_played") / 3.6e6, 1).alias("total_hours"),
        )
        .orderBy(F.desc(by), "artist_name")
        .limit(k)
    )
