"""Session tables and reports."""

from oracles.base import ENGAGED3, MINUTES, PCT, SKIP, SKIP_PCT, SPAN_US, avg1, over_metrics, over_plays, over_sessions, over_stats, r, re, rs, xavg

_HIGH = "avg(CASE WHEN session_quality = 'High Quality' THEN 1e0 ELSE 0e0 END) * 1e2"
_DAILY = f"""days AS (
 SELECT CAST(session_start AS DATE) AS session_date, primary_platform, count(*) AS daily_session_count,
  {avg1('session_duration_minutes')} AS avg_daily_session_duration, {avg1('session_skip_rate')} AS avg_daily_skip_rate
 FROM metrics GROUP BY 1, 2)"""


def _daily(window: str) -> str:
    prev = f"lag(daily_session_count) OVER ({window})"
    text = over_metrics("SELECT 1")
    body = f""",
{_DAILY}
SELECT session_date, primary_platform, daily_session_count, {prev} AS prev_day_sessions,
 {rs(f'(daily_session_count - {prev}) * 1e2 / nullif({prev}, 0)')} AS dod_session_change,
 avg_daily_session_duration, avg_daily_skip_rate,
 {r(f'avg(daily_session_count) OVER ({window} ROWS 6 PRECEDING)')} AS rolling_7d_sessions FROM days"""
    return text.replace("\nSELECT 1", body)


def _histogram(col: str, bins: int) -> str:
    text = over_stats("SELECT 1")
    body = f""",
edges AS (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM stats),
binned AS (SELECT CASE WHEN hi > lo THEN least(CAST(floor(({col} - lo) / ((hi - lo) / {bins}e0)) AS BIGINT), {bins - 1}) ELSE 0 END AS bin, count(*) AS n
 FROM stats, edges GROUP BY 1)
SELECT g.bin, {rs(f'lo + (hi - lo) / {bins}e0 * g.bin', 6)} AS lo, {rs(f'lo + (hi - lo) / {bins}e0 * (g.bin + 1)', 6)} AS hi, coalesce(b.n, 0) AS n
 FROM (SELECT unnest(range({bins})) AS bin) g CROSS JOIN edges LEFT JOIN binned b ON b.bin = g.bin"""
    return text.replace("\nSELECT 1", body)


TEXTS = {
    "se1_sessionize": over_sessions(
        'SELECT event_id, prev_timestamp, (epoch_us("timestamp") - epoch_us(prev_timestamp)) / 1e6 AS time_since_last, is_session_start, session_id FROM sessions'
    ),
    "se1_assign_sessions": over_sessions("SELECT event_id, session_id, is_session_start FROM sessions"),
    "se1_keyed_sessions": over_plays(
        """SELECT event_id, user_id, st AS is_session_start, CAST(sum(CASE WHEN st THEN 1 ELSE 0 END)
   OVER (PARTITION BY user_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
 FROM (SELECT *, p IS NULL OR "timestamp" - p > interval '6' hour AS st
   FROM (SELECT *, lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS p FROM plays))"""
    ),
    "se2_session_report": over_sessions(
        f"""SELECT session_id, min("timestamp") AS session_start, max("timestamp") AS session_end, count(*) AS tracks_in_session,
 {MINUTES} AS total_session_minutes, {r(SPAN_US + ' / 6e7')} AS session_duration_minutes, {SKIP_PCT} AS session_skip_rate,
 mode() WITHIN GROUP (ORDER BY platform) AS primary_platform FROM sessions GROUP BY session_id HAVING count(*) >= 2 ORDER BY session_id LIMIT 50"""
    ),
    "se3_session_metrics": over_metrics("SELECT * FROM metrics"),
    "se4_session_features": over_sessions(
        f"""SELECT event_id, s.session_id, session_track_count, session_skip_rate, session_avg_engagement, session_duration_minutes,
 CASE WHEN session_track_count >= 10 AND session_skip_rate <= 0.3e0 AND session_avg_engagement >= 0.7e0 THEN 'High'
   WHEN session_track_count >= 5 AND session_skip_rate <= 0.5e0 THEN 'Medium' ELSE 'Low' END AS session_quality
 FROM sessions s JOIN (SELECT session_id, count(*) AS session_track_count, {re(f'avg({SKIP})')} AS session_skip_rate,
   {ENGAGED3} AS session_avg_engagement, {re(SPAN_US + ' / 6e7', 1)} AS session_duration_minutes
   FROM sessions GROUP BY session_id) f ON f.session_id = s.session_id"""
    ),
    "se5_session_score": over_stats(
        f"SELECT session_id, primary_platform, {r('session_quality_score', 6)} AS session_quality_score, quality_category FROM scored"
    ),
    "se5_score_shares": over_stats(
        f"SELECT quality_category, count(*) AS n, {r('count(*) * 1e2 / sum(count(*)) OVER ()', 4)} AS pct FROM scored WHERE quality_category IS NOT NULL GROUP BY 1"
    ),
    "se5_score_by_platform": over_stats(
        f"SELECT primary_platform, {r(xavg('session_quality_score'), 4)} AS avg_score FROM scored GROUP BY 1"
    ),
    "se6_session_quality_report": over_metrics(
        f"""SELECT session_quality, count(*) AS session_count, {r('count(*) * 1e2 / sum(count(*)) OVER ()')} AS percentage,
 {r('avg(tracks_count)')} AS avg_tracks, {avg1('session_duration_minutes')} AS avg_duration_min,
 {avg1('session_skip_rate')} AS avg_skip_rate, {avg1('total_listening_minutes')} AS avg_listening_min FROM metrics GROUP BY 1"""
    ),
    "se7_session_platform_report": over_metrics(
        f"""SELECT primary_platform, count(*) AS session_count, {r('avg(tracks_count)')} AS avg_tracks_per_session,
 {avg1('session_duration_minutes')} AS avg_session_duration, {avg1('session_skip_rate')} AS avg_skip_rate,
 {avg1('total_listening_minutes')} AS avg_listening_time, {avg1('listening_efficiency')} AS avg_listening_efficiency,
 {_HIGH} AS high_quality_pct FROM metrics GROUP BY 1"""
    ),
    "se8_session_time_report": over_metrics(
        f"""SELECT session_time_period, session_start_hour, count(*) AS session_count, {r('avg(tracks_count)')} AS avg_tracks,
 {avg1('session_duration_minutes')} AS avg_duration, {avg1('session_skip_rate')} AS avg_skip_rate, {r(_HIGH)} AS high_quality_pct
 FROM metrics GROUP BY 1, 2"""
    ),
    "se9_session_journey": over_sessions(
        f"""SELECT track_position, total_occurrences, skip_rate_by_position, avg_completion_by_position, common_start_reason, common_end_reason,
 {rs('skip_rate_by_position - lag(skip_rate_by_position) OVER (ORDER BY track_position)')} AS skip_rate_change FROM (
 SELECT track_position, count(*) AS total_occurrences, {SKIP_PCT} AS skip_rate_by_position, {PCT} AS avg_completion_by_position,
  mode() WITHIN GROUP (ORDER BY reason_start) AS common_start_reason, mode() WITHIN GROUP (ORDER BY reason_end) AS common_end_reason
 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY "timestamp", event_id) AS INTEGER) AS track_position FROM sessions)
 WHERE track_position <= 10 GROUP BY 1)"""
    ),
    # The thresholds and labels of the session segments.
    "se10_session_segments": over_metrics(
        f"""SELECT *, CASE WHEN total_sessions >= 50 AND high_quality_session_pct >= 60 THEN 'Power User'
 WHEN total_sessions >= 20 AND high_quality_session_pct >= 40 THEN 'Engaged User'
 WHEN total_sessions >= 10 AND avg_session_skip_rate <= 40 THEN 'Casual User'
 WHEN avg_session_skip_rate > 60 THEN 'At-Risk User' ELSE 'New/Light User' END AS user_segment FROM (
 SELECT primary_platform AS user_platform, count(*) AS total_sessions, {r('avg(tracks_count)')} AS avg_tracks_per_session,
  {avg1('session_duration_minutes')} AS avg_session_duration, {avg1('session_skip_rate')} AS avg_session_skip_rate,
  {_HIGH} AS high_quality_session_pct, mode() WITHIN GROUP (ORDER BY session_time_period) AS preferred_time_period
 FROM metrics GROUP BY 1)"""
    ),
    "se11_daily_sessions": _daily("ORDER BY session_date, primary_platform"),
    "se11_daily_sessions_per_platform": _daily("PARTITION BY primary_platform ORDER BY session_date"),
    "se12_session_summary": over_stats(
        f"""SELECT count(*) AS sessions, {r('sum(tracks_count) / CAST(count(*) AS DOUBLE)', 4)} AS tracks_per_session,
 {avg1('session_duration_minutes', 4)} AS avg_duration, {r('avg(skip_rate)', 4)} AS avg_skip_rate,
 {r('count(*) / CAST(count(DISTINCT CAST(session_start AS DATE)) AS DOUBLE)', 4)} AS daily_sessions,
 quantile_cont(session_duration_minutes, 0.5) AS median_duration, quantile_cont(tracks_count, 0.5) AS median_tracks,
 quantile_cont(skip_rate, 0.5) AS median_skip_rate FROM stats"""
    ),
    "se12_platform_sessions": over_stats("SELECT primary_platform, count(*) AS plays FROM stats GROUP BY 1"),
    "ag37_histogram_duration": _histogram("session_duration_minutes", 50),
    "ag37_histogram_tracks": _histogram("tracks_count", 30),
    "ag37_histogram_skip_rate": _histogram("skip_rate", 30),
}
