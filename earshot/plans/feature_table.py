"""The full feature table: a cleaned log in, 82 feature columns out."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.constants import TS_FORMAT
from earshot.functions.times import micros_between
from earshot.operators import entities, features, ordered, sessions
from earshot.operators.joins import join_on
from earshot.sources.staging import stage, stage_all

# Column order of the result, by group.
CLEANED = (
    "track_uri", "ts", "platform", "ms_played", "track_name", "artist_name", "album_name",
    "reason_start", "reason_end", "shuffle", "skipped", "timestamp",
)
TEMPORAL = (
    "hour_of_day", "day_of_week", "day_of_week_num", "month", "year", "date", "week_of_year", "is_weekend",
    "is_workday", "time_of_day", "is_peak_hour", "is_morning_commute", "is_evening_commute", "is_late_night", "season",
)
BEHAVIOUR = (
    "seconds_played", "minutes_played", "estimated_track_length_ms", "percent_played", "track_length_seconds",
    "track_length_category", "is_skip", "listening_quality", "completion_score", "engagement_score",
)
ENTITY = (
    "user_play_count", "user_skip_rate", "user_avg_completion", "user_avg_engagement", "user_segment", "user_frequency",
)
CONTENT = (
    "track_play_count", "track_skip_rate", "track_avg_completion", "track_avg_engagement", "artist_play_count",
    "artist_unique_tracks", "artist_skip_rate", "artist_avg_engagement", "track_popularity", "artist_popularity",
)
SESSION = (
    "time_since_previous", "is_session_start", "session_id", "session_track_count", "session_skip_rate",
    "session_avg_engagement", "session_duration_minutes", "session_quality", "track_position_in_session",
)
CONTEXT = (
    "prev_platform", "platform_switch", "is_autoplay", "is_manual_start", "is_manual_skip", "is_natural_end",
    "is_binge_session", "is_short_session", "artist_diversity_in_session",
)
MODEL = (
    "hour_platform_interaction", "weekend_platform_interaction", "prev_track_skip", "prev_track_completion",
    "rolling_5_skip_rate", "rolling_5_avg_completion", "platform_encoded", "time_of_day_encoded",
    "listening_quality_encoded", "completion_squared", "track_length_log",
)
ALL = CLEANED + TEMPORAL + BEHAVIOUR + ENTITY + CONTENT + SESSION + CONTEXT + MODEL


def build(plays: DataFrame, gap: timedelta = sessions.GAP, leak_free: bool = False, chunk_rows: int | None = None) -> DataFrame:
    """``plays`` is a cleaned log with an ``event_id`` tie-break.

    One range shuffle orders the narrow log. Sessions, categories and one content rollup read it
    back with only their columns, as concurrent jobs; entity, track and artist tables add up from
    the rollup and are joined to its keys first, so that events meet one table of contents. All are
    staged so that the final joins know their sizes. The final pass takes lags and rolling means per
    chunk and joins contents and sessions: events are sorted once and, where no table can be broadcast,
    move five times.
    ``leak_free`` keeps the current play out of the rolling means.
    """
    small = stage_all({
        "track_lengths": features.longest_plays(plays),
        "session_buckets": sessions.session_buckets(plays, gap),
    })
    narrow = features.add_behaviour(plays.join(small["track_lengths"], "track_uri", "left"))
    log = ordered.order_log(narrow, chunk_rows=chunk_rows)
    bucket_map = sessions.session_map(small["session_buckets"], gap)

    known = sessions.join_sessions(features.add_time_of_day(features.add_calendar(log.rows)), bucket_map, gap)
    first_index = F.min("row_index").alias("_first_index")
    artists = F.countDistinct("artist_name").alias("artist_diversity_in_session")
    encoded = ["platform", "time_of_day", "listening_quality"]
    side = stage_all({
        "content_rollup": entities.content_rollup(known),
        "session_features": sessions.session_feature_table(known, [first_index, artists]),
        "codes": features.code_table(known, encoded),
    })
    rollup = side["content_rollup"]
    side |= stage_all({
        "entity_features": entities.rolled_entities(rollup),
        "track_stats": entities.rolled_tracks(rollup),
        "artist_stats": entities.rolled_artists(rollup),
    })

    content = stage(entities.content_table(rollup, side["entity_features"], side["track_stats"], side["artist_stats"]), "content")
    skip = F.when(F.col("is_skip"), 1.0).otherwise(0.0)
    seen = log.history(
        {
            "prev_timestamp": ordered.previous("timestamp"),
            "prev_platform": ordered.previous("platform"),
            "prev_track_skip": ordered.previous("is_skip"),
            "prev_track_completion": ordered.previous("percent_played"),
            "rolling_5_skip_rate": ordered.rolling_mean(skip, 5, leak_free),
            "rolling_5_avg_completion": ordered.rolling_mean(F.col("percent_played"), 5, leak_free),
        },
        reach=5 if leak_free else 4,
    )
    out = (
        sessions.join_sessions(features.temporal(ordered.fill_previous(seen)), bucket_map, gap)
        .transform(join_on, content, entities.CONTENT)
        .join(side["session_features"], "session_id", "left")
    )
    out = entities.popularity(features.attach_codes(out, side["codes"], encoded)).withColumns({
        "time_since_previous": micros_between(F.col("prev_timestamp"), F.col("timestamp")) / 1e6,
        "track_position_in_session": (F.col("row_index") - F.col("_first_index") + 1).cast("int"),
        "ts": F.date_format("timestamp", TS_FORMAT),
    })
    for step in (features.add_reason_flags, features.add_session_size_flags, features.add_crosses, features.add_nonlinear):
        out = out.transform(step)
    return out.select("event_id", *ALL)
