"""Common table expressions and small text helpers for the oracle SQL."""

from __future__ import annotations

GAP = "interval '10' minute"
SKIP = "CASE WHEN is_skip THEN 1e0 ELSE 0e0 END"
SHUF = "CASE WHEN shuffle THEN 1e0 ELSE 0e0 END"


def r(x: str, d: int = 1) -> str:
    return f"(floor(({x}) * 1e{d} + 0.5e0) / 1e{d})"


def rs(x: str, d: int = 1) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN 0e0 - floor(0.5e0 - ({x}) * 1e{d}) / 1e{d} ELSE floor(({x}) * 1e{d} + 0.5e0) / 1e{d} END)"


def re(x: str, d: int = 3) -> str:
    return f"(round_even(CAST(({x}) * 1e{d} AS DOUBLE), 0) / 1e{d})"


def xavg(x: str) -> str:
    """Mean over whole billionths: the order of rows cannot matter."""
    return f"(CAST(sum(CAST(round_even(CAST(({x}) * 1e9 AS DOUBLE), 0) AS HUGEINT)) AS DOUBLE) / 1e9 / count({x}))"


def avg1(x: str, d: int = 1) -> str:
    """Mean of one-decimal values: tenths are summed as integers, so the order of rows cannot matter."""
    return r(f"CAST(sum(CAST(round_even(CAST(({x}) * 1e1 AS DOUBLE), 0) AS BIGINT)) AS BIGINT) / 1e1 / count({x})", d)


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


MS = "CAST(sum(ms_played) AS BIGINT)"
HOURS = r(f"{MS} / 3.6e6")
MINUTES = r(f"{MS} / 6e4")
SECONDS = r(f"{MS} / 1e3 / count(*)")
SKIP_PCT = r(f"avg({SKIP}) * 1e2")
PCT = r(xavg("percent_played"))
SKIP3 = re(f"avg({SKIP})")
PCT3 = re(xavg("percent_played"))
ENGAGED3 = re(xavg("engagement_score"))
SHUF3 = re(f"avg({SHUF})")

DAY_PART = """CASE WHEN {h} BETWEEN 6 AND 11 THEN 'Morning' WHEN {h} BETWEEN 12 AND 17 THEN 'Afternoon'
 WHEN {h} BETWEEN 18 AND 21 THEN 'Evening' ELSE 'Night' END"""

BASE = """
catalog AS (
  SELECT e.*, p.p_name AS track_name, p.p_brand AS artist_name, p.p_type AS album_name,
         CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events e JOIN part p ON p.p_partkey = CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INTEGER)),
base AS (
  SELECT event_id, user_id, concat('track:', k) AS track_uri, CAST(ts AS TIMESTAMP) AS "timestamp",
    CASE event_type WHEN 'click' THEN 'android' WHEN 'view' THEN 'iOS' WHEN 'purchase' THEN 'windows'
      WHEN 'signup' THEN 'mac' ELSE 'web player' END AS platform,
    CASE WHEN floor(value * 1e3 + 0.5e0) > 60000 THEN 60000
      ELSE CAST(floor(value * 1e3 + 0.5e0) AS BIGINT) END AS ms_played,
    track_name, artist_name, album_name,
    CASE (event_id * 3 + user_id) % 6 WHEN 0 THEN 'clickrow' WHEN 1 THEN 'fwdbtn' WHEN 2 THEN 'autoplay'
      WHEN 3 THEN 'playbtn' ELSE 'trackdone' END AS reason_start,
    CASE (event_id * 7 + user_id) % 8 WHEN 0 THEN 'nextbtn' WHEN 1 THEN 'fwdbtn' WHEN 2 THEN 'endplay'
      WHEN 3 THEN 'backbtn' ELSE 'trackdone' END AS reason_end,
    (event_id + user_id) % 3 = 0 AS shuffle, event_id % 19 = 0 AS skipped
  FROM catalog)"""

PLAYS = BASE + f""",
lens AS (SELECT track_uri, max(ms_played) AS estimated_track_length_ms FROM base GROUP BY track_uri),
percents AS (
  SELECT b.*, l.estimated_track_length_ms,
    CASE WHEN estimated_track_length_ms > 0 THEN
      CASE WHEN ms_played * 1e2 / estimated_track_length_ms > 100 THEN 100e0
           ELSE ms_played * 1e2 / estimated_track_length_ms END
      ELSE 0e0 END AS percent_played
  FROM base b JOIN lens l ON l.track_uri = b.track_uri),
flags AS (
  SELECT *, skipped OR percent_played < 30 OR reason_end IN ('nextbtn', 'backbtn') AS is_skip FROM percents),
plays AS (
  SELECT *, estimated_track_length_ms / 1e3 AS track_length_seconds,
    ms_played / 1e3 AS seconds_played, ms_played / 1e3 / 60 AS minutes_played,
    CASE WHEN percent_played >= 80 THEN 'High' WHEN percent_played >= 50 THEN 'Medium' ELSE 'Low' END AS listening_quality,
    CASE WHEN estimated_track_length_ms <= 0 THEN NULL WHEN estimated_track_length_ms <= 120000 THEN '<2min'
      WHEN estimated_track_length_ms <= 180000 THEN '2-3min' WHEN estimated_track_length_ms <= 240000 THEN '3-4min'
      WHEN estimated_track_length_ms <= 300000 THEN '4-5min' ELSE '5min+' END AS track_length_category,
    percent_played / 1e2 AS completion_score,
    percent_played / 1e2 * 0.6e0 + (CASE WHEN is_skip THEN 0e0 ELSE 1e0 END) * 0.4e0 AS engagement_score,
    CAST(hour("timestamp") AS INTEGER) AS hour_of_day, dayname("timestamp") AS day_of_week,
    CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week_num, CAST(month("timestamp") AS INTEGER) AS month,
    CAST(year("timestamp") AS INTEGER) AS year, CAST("timestamp" AS DATE) AS date,
    CAST(week("timestamp") AS INTEGER) AS week_of_year, isodow("timestamp") >= 6 AS is_weekend, isodow("timestamp") <= 5 AS is_workday,
    {DAY_PART.format(h='hour("timestamp")')} AS time_of_day,
    hour("timestamp") IN (17, 18, 19, 20) AS is_peak_hour, hour("timestamp") IN (7, 8, 9) AS is_morning_commute,
    hour("timestamp") IN (17, 18, 19) AS is_evening_commute,
    hour("timestamp") IN (23, 0, 1, 2, 3, 4, 5) AS is_late_night,
    hour("timestamp") IN (22, 23, 0, 1, 2, 3, 4, 5) AS is_night,
    CASE WHEN month("timestamp") IN (12, 1, 2) THEN 'Winter' WHEN month("timestamp") IN (3, 4, 5) THEN 'Spring'
      WHEN month("timestamp") IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season
  FROM flags)"""

SESSIONS = PLAYS + f""",
lagged AS (
  SELECT *, lag("timestamp") OVER (ORDER BY "timestamp", event_id) AS prev_timestamp FROM plays),
started AS (
  SELECT *, (prev_timestamp IS NULL OR "timestamp" - prev_timestamp > {GAP}) AS is_session_start FROM lagged),
sessions AS (
  SELECT *, CAST(sum(CASE WHEN is_session_start THEN 1 ELSE 0 END)
    OVER (ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM started)"""

SPAN_US = '(epoch_us(max("timestamp")) - epoch_us(min("timestamp")))'

METRICS = SESSIONS + f""",
metrics AS (
  SELECT session_id, min("timestamp") AS session_start, max("timestamp") AS session_end, count(*) AS tracks_count,
    count(DISTINCT track_uri) AS unique_tracks, count(DISTINCT artist_name) AS unique_artists,
    {r(SPAN_US + ' / 6e7')} AS session_duration_minutes, {MINUTES} AS total_listening_minutes,
    {SECONDS} AS avg_track_duration, {SKIP_PCT} AS session_skip_rate, {PCT} AS avg_percent_played,
    {r(f'{MS} * 1e5 / nullif({SPAN_US}, 0)')} AS listening_efficiency,
    mode() WITHIN GROUP (ORDER BY platform) AS primary_platform, {r(f'avg({SHUF}) * 1e2')} AS shuffle_usage_pct,
    CAST(hour(min("timestamp")) AS INTEGER) AS session_start_hour, CAST(dayofweek(min("timestamp")) AS INTEGER) AS session_start_dow,
    {DAY_PART.format(h='hour(min("timestamp"))')} AS session_time_period,
    CASE WHEN count(*) >= 10 AND {xavg('percent_played')} >= 70 AND avg({SKIP}) <= 0.3e0 THEN 'High Quality'
      WHEN count(*) >= 5 AND {xavg('percent_played')} >= 50 AND avg({SKIP}) <= 0.5e0 THEN 'Medium Quality'
      ELSE 'Low Quality' END AS session_quality
  FROM sessions GROUP BY session_id HAVING count(*) >= 2)"""

STATS = SESSIONS + f""",
stats AS (
  SELECT session_id, min("timestamp") AS session_start, max("timestamp") AS session_end, count(*) AS tracks_count,
    {re(f'{MS} / 1e3', 2)} AS total_seconds, {re(f'avg({SKIP})', 2)} AS skip_rate,
    mode() WITHIN GROUP (ORDER BY platform) AS primary_platform,
    {re(SPAN_US + ' / 6e7', 1)} AS session_duration_minutes, {re(f'{MS} / 6e4', 1)} AS total_minutes
  FROM sessions GROUP BY session_id),
scored AS (
  SELECT *, CASE WHEN s <= 0 THEN NULL WHEN s <= 33 THEN 'Low' WHEN s <= 66 THEN 'Medium' WHEN s <= 100 THEN 'High' END AS quality_category,
    s AS session_quality_score
  FROM (SELECT *, (session_duration_minutes / max(session_duration_minutes) OVER () * 0.3e0
      + tracks_count / CAST(max(tracks_count) OVER () AS DOUBLE) * 0.3e0
      + (1 - skip_rate) / max(1 - skip_rate) OVER () * 0.4e0) * 100 AS s FROM stats))"""

DIRTY = BASE + """,
faulty AS (
  SELECT event_id, concat('track:', k) AS track_uri,
    CASE WHEN event_id % 103 = 0 THEN 'bad' ELSE strftime(CAST(ts AS TIMESTAMP), '%d-%m-%Y %H:%M') END AS ts,
    CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 131 = 0 THEN NULL ELSE ' ' || event_type END AS platform,
    CASE WHEN event_id % 107 = 0 THEN '-1' WHEN event_id % 109 = 0 THEN 'abc' WHEN event_id % 113 = 0 THEN NULL
      WHEN event_id % 127 = 0 THEN '1200000' ELSE CAST(CAST(floor(value * 1e3 + 0.5e0) AS BIGINT) AS VARCHAR) END AS ms_played,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE track_name END AS track_name, artist_name, album_name,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'trackdone' END AS reason_start, 'endplay' AS reason_end,
    CASE event_id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN 'T' ELSE 'x' END AS shuffle,
    CASE WHEN event_id % 19 = 0 THEN 'True' ELSE 'False' END AS skipped
  FROM catalog),
dirty AS (SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE event_id % 83 = 0)"""

TYPED = DIRTY + """,
typed AS (
  SELECT event_id, track_uri, ts, CASE WHEN coalesce(trim(platform), '') = '' THEN 'Unknown' ELSE trim(platform) END AS platform,
    try_cast(ms_played AS DOUBLE) AS ms_played, coalesce(trim(track_name), 'Unknown') AS track_name, artist_name, album_name,
    coalesce(reason_start, 'Unknown') AS reason_start, reason_end,
    coalesce(upper(shuffle) IN ('TRUE', 'T'), false) AS shuffle, coalesce(upper(skipped) IN ('TRUE', 'T'), false) AS skipped,
    try_strptime(ts, '%d-%m-%Y %H:%M') AS "timestamp"
  FROM dirty WHERE track_uri IS NOT NULL AND ts IS NOT NULL AND ms_played IS NOT NULL
    AND try_strptime(ts, '%d-%m-%Y %H:%M') IS NOT NULL),
valid AS (
  SELECT * REPLACE (CASE WHEN ms_played > 900000 THEN 900000e0 ELSE ms_played END AS ms_played)
  FROM typed WHERE ms_played >= 0),
cleaned AS (SELECT DISTINCT * FROM valid)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def over_plays(body: str) -> str:
    return sql(PLAYS, body)


def over_sessions(body: str) -> str:
    return sql(SESSIONS, body)


def over_metrics(body: str) -> str:
    return sql(METRICS, body)


def over_stats(body: str) -> str:
    return sql(STATS, body)


def over_dirty(body: str) -> str:
    return sql(TYPED, body)
