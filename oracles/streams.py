"""What streams give once their input has ended: the same as the batch."""

from oracles.base import MS, SKIP, over_dirty, over_plays, r


def _windows(starts: str) -> str:
    return over_plays(
        f"""SELECT s AS window_start, s + interval '1' hour AS window_end, count(*) AS plays, {r(f'avg({SKIP})', 6)} AS skip_rate, {r(f'{MS} / 3.6e6', 6)} AS hours
 FROM (SELECT *, {starts} AS s FROM plays) GROUP BY s"""
    )


def _mean(x: str, window: str) -> str:
    """Over whole billionths: the order of rows cannot matter."""
    return f"(CAST(sum(CAST(round_even(CAST(({x}) * 1e9 AS DOUBLE), 0) AS HUGEINT)) OVER {window} AS DOUBLE) / 1e9 / count({x}) OVER {window})"


TEXTS = {
    "xs1_stream_sessions": over_plays(
        f"""SELECT user_id, min("timestamp") AS session_start, max("timestamp") AS session_end, count(*) AS tracks, {r(f'{MS} / 6e4', 6)} AS minutes,
 {r(f'avg({SKIP})', 6)} AS skip_rate FROM (
 SELECT *, sum(CASE WHEN p IS NULL OR "timestamp" - p > interval '6' hour THEN 1 ELSE 0 END)
   OVER (PARTITION BY user_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS sid
 FROM (SELECT *, lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS p FROM plays))
 GROUP BY user_id, sid"""
    ),
    "xs4_stream_features": over_plays(
        f"""SELECT event_id, user_id, prev_platform, coalesce(platform <> prev_platform, true) AS platform_switch, coalesce(prev_skip, false) AS prev_track_skip,
 {r('coalesce(prev_completion, 0e0)', 6)} AS prev_track_completion, {r('rolling_skip', 6)} AS rolling_5_skip_rate, {r('rolling_completion', 6)} AS rolling_5_avg_completion,
 row_number() OVER (PARTITION BY user_id, sid ORDER BY "timestamp", event_id) AS track_position_in_session, count(*) OVER s AS session_track_count,
 {r(_mean('CASE WHEN is_skip THEN 1e0 ELSE 0e0 END', 's'), 6)} AS session_skip_rate, {r(_mean('engagement_score', 's'), 6)} AS session_avg_engagement,
 {r('(epoch_us(max("timestamp") OVER s) - epoch_us(min("timestamp") OVER s)) / 6e7', 6)} AS session_duration_minutes
 FROM (
 SELECT *, sum(CASE WHEN p IS NULL OR "timestamp" - p > interval '6' hour THEN 1 ELSE 0 END) OVER (u ROWS UNBOUNDED PRECEDING) AS sid FROM (
  SELECT *, lag("timestamp") OVER u AS p, lag(platform) OVER u AS prev_platform, lag(is_skip) OVER u AS prev_skip, lag(percent_played) OVER u AS prev_completion,
   {_mean("CASE WHEN is_skip THEN 1e0 ELSE 0e0 END", "(u ROWS 4 PRECEDING)")} AS rolling_skip, {_mean("percent_played", "(u ROWS 4 PRECEDING)")} AS rolling_completion
  FROM plays WINDOW u AS (PARTITION BY user_id ORDER BY "timestamp", event_id))
 WINDOW u AS (PARTITION BY user_id ORDER BY "timestamp", event_id))
 WINDOW s AS (PARTITION BY user_id, sid)"""
    ),
    "xs2_stream_kpis": _windows("date_trunc('hour', \"timestamp\")"),
    "xs2_stream_kpis_sliding": _windows(
        "unnest([time_bucket(interval '30' minute, \"timestamp\"), time_bucket(interval '30' minute, \"timestamp\") - interval '30' minute])"
    ),
    "xs3_stream_dedupe": over_dirty(
        """SELECT DISTINCT event_id, try_strptime(ts, '%d-%m-%Y %H:%M') AS "timestamp", track_uri FROM dirty
 WHERE try_strptime(ts, '%d-%m-%Y %H:%M') IS NOT NULL"""
    ),
}
