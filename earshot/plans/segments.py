"""Skip risk of tracks and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.joins import attach, with_modes
from earshot.plans import measures as m
from earshot.sources.staging import stage


def track_history(plays: DataFrame) -> DataFrame:
    return plays.groupBy("track_uri", "track_name", "artist_name").agg(
        m.plays().alias("track_play_count"),
        m.skip_pct().alias("historical_skip_rate"),
        (F.max("estimated_track_length_ms") / 1e3).alias("track_length_seconds"),
    )


def entity_behaviour(plays: DataFrame, entity: str = "track_uri") -> DataFrame:
    stats = plays.groupBy(entity).agg(
        m.plays().alias("user_total_plays"),
        m.skip_pct().alias("user_skip_tendency"),
        m.completion().alias("user_avg_completion"),
    )
    return with_modes(stats, plays, [entity], {"preferred_platform": "platform"})


def _class(x: Column, high: float, medium: float, labels: tuple[str, str, str]) -> Column:
    return F.when(x > high, labels[0]).when(x > medium, labels[1]).otherwise(labels[2])


def with_history_stats(plays: DataFrame, entity: str = "track_uri", source: DataFrame | None = None) -> DataFrame:
    """Plays joined to their track's and entity's history; ``source`` is the log the history comes from."""
    log = source if source is not None else plays
    base = plays.drop("track_length_seconds")
    joined = attach(base, track_history(log), ["track_uri", "track_name", "artist_name"], "track_history", how="inner")
    return attach(joined, entity_behaviour(log, entity), [entity], "entity_behaviour", how="inner")


def with_risk(joined: DataFrame) -> DataFrame:
    return joined.withColumns({
        "track_skip_risk": _class(F.col("historical_skip_rate"), 70, 40, ("High Risk", "Medium Risk", "Low Risk")),
        "user_skip_profile": _class(
            F.col("user_skip_tendency"), 60, 30, ("High Skip User", "Medium Skip User", "Low Skip User")
        ),
    })


def skip_risk(plays: DataFrame, k: int = 1000, entity: str = "track_uri", tiebreak: str = "event_id") -> DataFrame:
    """The latest ``k`` plays with risk classes from the whole log's history.

    Top-k comes before the joins: they keep every play, so only ``k`` rows are joined.
    """
    latest = stage(plays.orderBy(F.desc("timestamp"), F.desc(tiebreak)).limit(k), "latest_plays")
    # the staged rows have a known size, so Spark decides whether to broadcast them
    relevant = plays.join(latest.select("track_uri"), "track_uri", "left_semi")
    source = relevant if entity == "track_uri" else plays
    return with_risk(with_history_stats(latest, entity, source)).orderBy(F.desc("timestamp"), F.desc(tiebreak))
