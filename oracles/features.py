"""Row features, joins, ordered operators, scalar functions, filters and sorting."""

from oracles.base import ENGAGED3, PCT, PCT3, SESSIONS, SHUF3, SKIP, SKIP3, big, over_plays, over_sessions, r, re, sql

_W = 'OVER (ORDER BY "timestamp", event_id)'
_ROLL = 'OVER (ORDER BY "timestamp", event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)'

# The 82 feature columns plus the event id, with plain windows.
FEATURES = SESSIONS + f""",
ent AS (
  SELECT track_uri, count(*) AS user_play_count, {SKIP3} AS user_skip_rate, {PCT3} AS user_avg_completion,
    {ENGAGED3} AS user_avg_engagement,
    count(*) / CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 8.64e10) + 1 AS DOUBLE) AS user_frequency
  FROM plays GROUP BY track_uri),
trk AS (
  SELECT track_name, artist_name, count(*) AS track_play_count, {SKIP3} AS track_skip_rate, {PCT3} AS track_avg_completion,
    {ENGAGED3} AS track_avg_engagement
  FROM plays GROUP BY track_name, artist_name),
art AS (
  SELECT artist_name, count(*) AS artist_play_count, count(DISTINCT track_name) AS artist_unique_tracks,
    {SKIP3} AS artist_skip_rate, {ENGAGED3} AS artist_avg_engagement
  FROM plays GROUP BY artist_name),
ses AS (
  SELECT session_id, count(*) AS session_track_count, {SKIP3} AS session_skip_rate,
    {ENGAGED3} AS session_avg_engagement,
    {re('(epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 6e7', 1)} AS session_duration_minutes,
    count(DISTINCT artist_name) AS artist_diversity_in_session
  FROM sessions GROUP BY session_id),
joined AS (
  SELECT s.*, ent.* EXCLUDE (track_uri), trk.* EXCLUDE (track_name, artist_name), art.* EXCLUDE (artist_name), ses.* EXCLUDE (session_id)
  FROM sessions s JOIN ent USING (track_uri) JOIN trk USING (track_name, artist_name) JOIN art USING (artist_name) JOIN ses USING (session_id)),
features AS (
  SELECT event_id, track_uri, strftime("timestamp", '%d-%m-%Y %H:%M') AS ts, platform, ms_played, track_name, artist_name,
    album_name, reason_start, reason_end, shuffle, skipped, "timestamp", hour_of_day, day_of_week, day_of_week_num, month,
    year, date, week_of_year, is_weekend, is_workday, time_of_day, is_peak_hour, is_morning_commute, is_evening_commute,
    is_late_night, season, seconds_played, minutes_played, estimated_track_length_ms, percent_played, track_length_seconds,
    track_length_category, is_skip, listening_quality, completion_score, engagement_score,
    user_play_count, user_skip_rate, user_avg_completion, user_avg_engagement,
    CASE WHEN user_play_count >= 20 AND user_avg_engagement >= 0.7e0 THEN 'Power User'
      WHEN user_play_count >= 10 AND user_avg_engagement >= 0.5e0 THEN 'Engaged User'
      WHEN user_skip_rate >= 0.6e0 THEN 'At-Risk User' ELSE 'Casual User' END AS user_segment, user_frequency,
    track_play_count, track_skip_rate, track_avg_completion, track_avg_engagement, artist_play_count, artist_unique_tracks,
    artist_skip_rate, artist_avg_engagement,
    CASE WHEN track_play_count <= 5 THEN 'Rare' WHEN track_play_count <= 20 THEN 'Uncommon'
      WHEN track_play_count <= 50 THEN 'Popular' ELSE 'Very Popular' END AS track_popularity,
    CASE WHEN artist_play_count <= 10 THEN 'Niche' WHEN artist_play_count <= 50 THEN 'Emerging'
      WHEN artist_play_count <= 200 THEN 'Mainstream' ELSE 'Superstar' END AS artist_popularity,
    (epoch_us("timestamp") - epoch_us(prev_timestamp)) / 1e6 AS time_since_previous, is_session_start, session_id,
    session_track_count, session_skip_rate, session_avg_engagement, session_duration_minutes,
    CASE WHEN session_track_count >= 10 AND session_skip_rate <= 0.3e0 AND session_avg_engagement >= 0.7e0 THEN 'High'
      WHEN session_track_count >= 5 AND session_skip_rate <= 0.5e0 THEN 'Medium' ELSE 'Low' END AS session_quality,
    CAST(row_number() OVER (PARTITION BY session_id ORDER BY "timestamp", event_id) AS INTEGER) AS track_position_in_session,
    lag(platform) {_W} AS prev_platform, coalesce(platform <> lag(platform) {_W}, true) AS platform_switch,
    reason_start = 'autoplay' AS is_autoplay, reason_start IN ('clickrow', 'playbtn') AS is_manual_start,
    reason_end IN ('nextbtn', 'backbtn') AS is_manual_skip, reason_end = 'trackdone' AS is_natural_end,
    session_track_count >= 20 AS is_binge_session, session_track_count <= 3 AS is_short_session, artist_diversity_in_session,
    concat(hour_of_day, '_', platform) AS hour_platform_interaction,
    concat(CASE WHEN is_weekend THEN 'True' ELSE 'False' END, '_', platform) AS weekend_platform_interaction,
    coalesce(lag(is_skip) {_W}, false) AS prev_track_skip, coalesce(lag(percent_played) {_W}, 0e0) AS prev_track_completion,
    {r(f'avg({SKIP}) {_ROLL}', 6)} AS rolling_5_skip_rate, {r(f'avg(percent_played) {_ROLL}', 6)} AS rolling_5_avg_completion,
    CAST(dense_rank() OVER (ORDER BY platform) - 1 AS INTEGER) AS platform_encoded, CAST(dense_rank() OVER (ORDER BY time_of_day) - 1 AS INTEGER) AS time_of_day_encoded,
    CAST(dense_rank() OVER (ORDER BY listening_quality) - 1 AS INTEGER) AS listening_quality_encoded,
    percent_played * percent_played AS completion_squared, {r('ln(1 + track_length_seconds)', 6)} AS track_length_log
  FROM joined)"""


def over_features(body: str) -> str:
    return sql(FEATURES, body)


def _cols(names: str) -> str:
    return over_plays(f"SELECT event_id, {names} FROM plays")


# Scalar functions: key -> (output, SQL). The Spark side is in the entry module under the same keys.
SCALARS = {
    "sf1_round_half_up": r("percent_played", 1),
    "sf2_round_half_even": re("percent_played", 1),
    "sf3_power_log1p": r("power(completion_score, 2) + ln(1 + seconds_played)", 6),
    "sf4_minimum": "CASE WHEN ms_played > 30000 THEN 30000 ELSE ms_played END",
    "sf5_abs": "abs(ms_played - 30000)",
    "sf6_modulo": "(hour_of_day + 2) % 24",
    "sf7_guarded_division": "ms_played * 1e0 / nullif(hour_of_day, 0)",
    "sf8_parse_timestamp": "try_strptime(CASE WHEN event_id % 7 = 0 THEN '31-02-2024 10:00' ELSE strftime(\"timestamp\", '%d-%m-%Y %H:%M') END, '%d-%m-%Y %H:%M')",
    "sf9_format_timestamp": "strftime(\"timestamp\", '%Y-%m-%d %H:%M')",
    "sf10_hour": 'CAST(hour("timestamp") AS INTEGER)',
    "sf11_weekday_numbers": 'CAST((isodow("timestamp") - 1) * 10 + dayofweek("timestamp") AS INTEGER)',
    "sf12_weekday_name": 'dayname("timestamp")',
    "sf13_week_month_year": 'CAST(year("timestamp") * 10000 + month("timestamp") * 100 + week("timestamp") AS INTEGER)',
    "sf14_week_start": "CAST(date_trunc('week', \"timestamp\") AS DATE)",
    "sf15_minute_start": "date_trunc('minute', \"timestamp\")",
    "sf16_date": 'CAST("timestamp" AS DATE)',
    "sf17_gap_over_limit": "\"timestamp\" - date_trunc('hour', \"timestamp\") > interval '30' minute",
    "sf18_interval_minutes": "(epoch_us(\"timestamp\") - epoch_us(date_trunc('day', \"timestamp\"))) / 6e7",
    "sf19_whole_days": "CAST(floor((epoch_us(\"timestamp\") - epoch_us(TIMESTAMP '2024-01-01 12:00:00')) / 8.64e10) AS BIGINT)",
    "sf20_upper_lower_trim": "upper(platform) || lower(artist_name) || trim(' ' || album_name || ' ')",
    "sf21_replace_empty": "CASE WHEN CASE WHEN platform = 'iOS' THEN '' ELSE platform END = '' THEN 'Unknown' ELSE platform END",
    "sf22_concatenate": "concat(track_name, '_', artist_name)",
    "sf23_ellipsis": "CASE WHEN length(track_name) > 8 THEN substr(track_name, 1, 8) || '...' ELSE track_name END",
    "sf24_number_text": "CAST(CAST(" + r("percent_played", 1) + " AS DECIMAL(20,1)) AS VARCHAR) || '% of ' || format('{:,}', estimated_track_length_ms)",
    "sf25_casts": "CAST(is_skip AS INTEGER) + coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS BIGINT), 0)",
    "sf26_conditional": "CASE WHEN percent_played >= 80 THEN 'High' WHEN percent_played >= 50 THEN 'Medium' ELSE 'Low' END",
    "sf27_null_handling": "coalesce(nullif(platform, 'android'), 'none')",
    "sf28_membership": "platform IN ('iOS', 'mac') AND hour_of_day BETWEEN 6 AND 11 OR NOT shuffle",
    "sf29_right_closed_bins": "CASE WHEN ms_played <= 0 THEN NULL WHEN ms_played <= 20000 THEN 'short' WHEN ms_played <= 40000 THEN 'middle' ELSE 'long' END",
    "sf30_equal_width_bins": "CAST(CASE WHEN floor((percent_played - 0e0) / (100e0 / 30e0)) >= 30 THEN 29 ELSE floor((percent_played - 0e0) / (100e0 / 30e0)) END AS BIGINT)",
}

_PLATFORMS = ("android", "iOS", "mac", "web player", "windows")
_REASONS = ("autoplay", "clickrow", "fwdbtn", "playbtn", "trackdone")
ONE_HOT = ", ".join(
    [f"CASE WHEN platform = '{p}' THEN 1 ELSE 0 END AS \"platform_{p}\"" for p in _PLATFORMS]
    + [f"CASE WHEN reason_start = '{x}' THEN 1 ELSE 0 END AS reason_start_{x}" for x in _REASONS]
    + ["CASE WHEN track_length_seconds > 240 THEN 1 ELSE 0 END AS is_long_track",
       "CASE WHEN track_length_seconds < 120 THEN 1 ELSE 0 END AS is_short_track", "CAST(shuffle AS INTEGER) AS shuffle_int"]
)

# What a column name must contain or start with to count for a group, and Spark's names of types.
_PARTS = {
    "temporal": ("hour", "day", "time", "season", "weekend", "morning", "evening", "night", "peak"),
    "behavioral": ("skip", "completion", "engagement", "listening", "quality"),
    "content": ("track_", "artist_", "album_"),
}
_STARTS = {"user": "user_", "session": "session_"}
_TYPES = {"VARCHAR": "string", "INTEGER": "int"}


def _inventory() -> str:
    groups = {g: " OR ".join(f"contains(c, '{p}')" for p in parts) for g, parts in _PARTS.items()} | {g: f"starts_with(c, '{s}')" for g, s in _STARTS.items()}
    named = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())
    columns = r"(UNPIVOT (SELECT typeof(COLUMNS('(.*)')) AS '\1' FROM features LIMIT 1) ON COLUMNS(*) INTO NAME c VALUE t)"
    counted = "".join(f" UNION ALL SELECT 'group', '{g}', count(*) FILTER ({x}) FROM cols" for g, x in groups.items())
    return (
        f"SELECT * FROM (WITH cols AS MATERIALIZED (SELECT lower(c) AS c, CASE t {named} ELSE lower(t) END AS t FROM {columns}) "
        f"SELECT 'all' AS kind, 'columns' AS name, count(*) AS n_columns FROM cols{counted} UNION ALL SELECT 'type', t, count(*) FROM cols GROUP BY t)"
    )


_INVENTORY = _inventory()

TEXTS = {
    "ft1_calendar": _cols("hour_of_day, day_of_week, day_of_week_num, month, year, date, week_of_year"),
    "ft2_week_flags": _cols("is_weekend, is_workday"),
    "ft3_time_of_day": _cols("time_of_day"),
    "ft4_hour_flags": _cols("is_peak_hour, is_morning_commute, is_evening_commute, is_late_night, is_night"),
    "ft5_season": _cols("season"),
    "fb1_durations": _cols("seconds_played, minutes_played"),
    "fb2_max_length": _cols("estimated_track_length_ms, track_length_seconds"),
    "fb3_percent_played": _cols("percent_played"),
    "fb4_length_bin": _cols("track_length_category"),
    "fb5_is_skip": _cols("is_skip"),
    "fb6_quality": _cols("listening_quality"),
    "fb7_engagement": _cols("completion_score, engagement_score"),
    "fc1_reason_flags": _cols(
        "reason_start = 'autoplay' AS is_autoplay, reason_start IN ('clickrow', 'playbtn') AS is_manual_start,"
        " reason_end IN ('nextbtn', 'backbtn') AS is_manual_skip, reason_end = 'trackdone' AS is_natural_end"
    ),
    "fc2_session_size_flags": over_features("SELECT event_id, is_binge_session, is_short_session FROM features"),
    "fm1_crosses": over_features("SELECT event_id, hour_platform_interaction, weekend_platform_interaction FROM features"),
    "fm2_encode_sorted": over_features(
        "SELECT event_id, platform_encoded, time_of_day_encoded, listening_quality_encoded FROM features"
    ),
    "fm3_nonlinear": over_features("SELECT event_id, completion_squared, track_length_log FROM features"),
    "fm4_one_hot_sparse": over_plays(
        """SELECT event_id, (SELECT count(DISTINCT track_name) FROM plays) AS n_tracks, dense_rank() OVER (ORDER BY track_name) - 1 AS track FROM plays"""
    ),
    "fm4_one_hot": over_plays(f"SELECT event_id, {ONE_HOT} FROM plays"),
    "feature_table": over_features("SELECT * FROM features"),
    "fl1_where": over_plays(
        "SELECT event_id, platform, hour_of_day, ms_played FROM plays WHERE platform IN ('iOS', 'mac') AND hour_of_day BETWEEN 6 AND 11 AND shuffle AND ms_played <= 59999"
    ),
    "fl2_having": over_plays(
        "SELECT track_uri, artist_name, count(*) AS plays FROM plays GROUP BY track_uri, artist_name HAVING plays >= 100"
    ),
    "fl3_case_nullif_coalesce": over_plays(
        """SELECT event_id, CASE platform WHEN 'iOS' THEN 'phone' WHEN 'android' THEN 'phone' ELSE 'other' END AS device,
 ms_played * 1e0 / nullif(hour_of_day, 0) AS ms_per_hour, coalesce(nullif(reason_start, 'trackdone'), 'natural') AS start_label FROM plays"""
    ),
    "fl4_select_available": over_plays(
        """SELECT event_id, CAST(hour_of_day AS DOUBLE) AS hour_of_day, CAST(is_weekend AS DOUBLE) AS is_weekend,
 track_length_seconds FROM plays"""
    ),
    "jn1_with_cohort": over_plays(
        """SELECT event_id, p.track_uri, CAST(f.w AS DATE) AS cohort_week FROM plays p
 JOIN (SELECT track_uri, date_trunc('week', min("timestamp")) AS w FROM plays GROUP BY 1) f ON f.track_uri = p.track_uri"""
    ),
    "jn2_history_join": over_plays(
        f"""SELECT event_id, track_play_count, historical_skip_rate, h.track_length_seconds, user_total_plays, user_skip_tendency,
 user_avg_completion, preferred_platform FROM plays p
 JOIN (SELECT track_uri, track_name, artist_name, count(*) AS track_play_count, {r(f'avg({SKIP}) * 1e2')} AS historical_skip_rate,
   max(estimated_track_length_ms) / 1e3 AS track_length_seconds FROM plays GROUP BY ALL) h
   ON h.track_uri = p.track_uri AND h.track_name = p.track_name AND h.artist_name = p.artist_name
 JOIN (SELECT track_uri, count(*) AS user_total_plays, {r(f'avg({SKIP}) * 1e2')} AS user_skip_tendency, {PCT} AS user_avg_completion,
   mode() WITHIN GROUP (ORDER BY platform) AS preferred_platform FROM plays GROUP BY 1) u ON u.track_uri = p.track_uri"""
    ),
    "jn3_attach": over_features(
        "SELECT event_id, user_play_count, user_skip_rate, track_play_count, track_skip_rate, artist_play_count, artist_unique_tracks FROM features"
    ),
    "jn4_with_columns": over_plays("SELECT event_id, CAST(platform = 'iOS' AS INTEGER) AS is_ios, CAST(platform = 'mac' AS INTEGER) AS is_mac FROM plays"),
    "jn5_normalise_by_max": over_plays(
        """SELECT platform, n, ms, n / CAST(max(n) OVER () AS DOUBLE) AS n_norm, ms / CAST(max(ms) OVER () AS DOUBLE) AS ms_norm
 FROM (SELECT platform, count(*) AS n, CAST(sum(ms_played) AS BIGINT) AS ms FROM plays GROUP BY 1)"""
    ),
    "og1_ordered_lag": over_plays(
        f"""SELECT event_id, lag("timestamp") {_W} AS prev_timestamp,
 (epoch_us("timestamp") - epoch_us(lag("timestamp") {_W})) / 1e6 AS gap_seconds FROM plays"""
    ),
    "og1_keyed_lag": over_plays(
        """SELECT event_id, lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS prev_timestamp,
 (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", event_id))) / 1e6 AS gap_seconds FROM plays"""
    ),
    "og2_with_previous": over_features(
        "SELECT event_id, prev_platform, platform_switch, prev_track_skip, prev_track_completion FROM features"
    ),
    "og3_running_sum": over_plays(
        f'SELECT event_id, {big("sum(CASE WHEN is_skip THEN 1 ELSE 0 END) OVER (ORDER BY " + chr(34) + "timestamp" + chr(34) + ", event_id ROWS UNBOUNDED PRECEDING)")} AS running FROM plays'
    ),
    "og3_keyed_running_sum": over_plays(
        f'SELECT event_id, {big("sum(CASE WHEN is_skip THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY " + chr(34) + "timestamp" + chr(34) + ", event_id ROWS UNBOUNDED PRECEDING)")} AS running FROM plays'
    ),
    "og4_rolling": over_features("SELECT event_id, rolling_5_skip_rate, rolling_5_avg_completion FROM features"),
    "og4_rolling_leak_free": over_plays(
        f"""SELECT event_id, {r(f'avg({SKIP}) OVER (ORDER BY "timestamp", event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)', 6)} AS rolling_5_skip_rate,
 {r('avg(percent_played) OVER (ORDER BY "timestamp", event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)', 6)} AS rolling_5_avg_completion FROM plays"""
    ),
    "og5_position": over_features("SELECT event_id, session_id, track_position_in_session FROM features"),
    "og6_session_diversity": over_features("SELECT event_id, artist_diversity_in_session FROM features"),
    "sl1_order_by": over_plays(
        "SELECT platform, nullif(time_of_day, 'Night') AS part, count(*) AS plays FROM plays GROUP BY ALL ORDER BY platform, part NULLS LAST"
    ),
    "sl2_top_k": over_plays('SELECT event_id, "timestamp", track_name FROM plays ORDER BY "timestamp" DESC, event_id DESC LIMIT 1000'),
    "sl3_order_log": over_plays(f'SELECT event_id, "timestamp", row_number() {_W} AS row_index FROM plays'),
    "st1_union_all": over_plays(
        """SELECT 'platform' AS dimension, platform AS category, count(*) AS plays FROM plays GROUP BY platform
 UNION ALL SELECT 'time_of_day', time_of_day, count(*) FROM plays GROUP BY time_of_day"""
    ),
    "ag19_entity_stats": over_plays(
        f"""SELECT track_uri, count(*) AS play_count, min("timestamp") AS first_play, max("timestamp") AS last_play, {SKIP3} AS skip_rate,
 {PCT3} AS avg_completion, {ENGAGED3} AS avg_engagement, {SHUF3} AS shuffle_rate,
 mode() WITHIN GROUP (ORDER BY platform) AS preferred_platform, {re('CAST(sum(ms_played) AS BIGINT) / 1e3')} AS total_seconds,
 CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 8.64e10) AS BIGINT) + 1 AS lifespan_days,
 count(*) / CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 8.64e10) + 1 AS DOUBLE) AS frequency
 FROM plays GROUP BY track_uri"""
    ),
    "ag20_content_stats": over_features(
        """SELECT DISTINCT track_name, artist_name, track_play_count, track_skip_rate, track_avg_completion, track_avg_engagement,
 artist_play_count, artist_unique_tracks, artist_skip_rate, artist_avg_engagement, track_popularity, artist_popularity FROM features"""
    ),
    "ag21_popularity": over_features("SELECT event_id, track_popularity, artist_popularity FROM features"),
    "ag22_cluster_profile": over_sessions(
        f"""SELECT *, total_seconds / 60 AS total_minutes, total_plays / CAST(total_sessions AS DOUBLE) AS avg_session_length,
 total_seconds / 60 / total_sessions AS listening_intensity FROM (
 SELECT track_uri, count(*) AS total_plays, {re('CAST(sum(ms_played) AS BIGINT) / 1e3')} AS total_seconds,
 {re('CAST(sum(ms_played) AS BIGINT) / 1e3 / count(*)')} AS avg_seconds_per_play, {SKIP3} AS skip_rate, {PCT3} AS avg_completion,
 {ENGAGED3} AS avg_engagement, {SHUF3} AS shuffle_rate,
 mode() WITHIN GROUP (ORDER BY platform) AS preferred_platform, mode() WITHIN GROUP (ORDER BY time_of_day) AS preferred_time,
 count(DISTINCT session_id) AS total_sessions, count(DISTINCT artist_name) AS artist_diversity,
 count(DISTINCT track_name) AS track_diversity FROM sessions GROUP BY track_uri HAVING count(*) >= 5)"""
    ),
    "ag23_entity_profile": over_plays(
        f"""SELECT *, total_seconds / 60 AS total_minutes, avg_percent_played * (1 - skip_rate) AS engagement_score FROM (
 SELECT track_uri, count(*) AS play_count, {re('CAST(sum(ms_played) AS BIGINT) / 1e3')} AS total_seconds,
 {re('CAST(sum(ms_played) AS BIGINT) / 1e3 / count(*)')} AS avg_seconds_per_play, {SKIP3} AS skip_rate, {PCT3} AS avg_percent_played,
 {SHUF3} AS shuffle_rate, mode() WITHIN GROUP (ORDER BY hour_of_day) AS preferred_hour,
 mode() WITHIN GROUP (ORDER BY platform) AS preferred_platform, {re('avg(day_of_week_num)')} AS avg_day_of_week
 FROM plays GROUP BY track_uri HAVING count(*) >= 3)"""
    ),
    "ag24_mode": over_plays(
        """SELECT artist_name, mode() WITHIN GROUP (ORDER BY platform) AS platform, mode() WITHIN GROUP (ORDER BY reason_start) AS reason_start,
 mode() WITHIN GROUP (ORDER BY hour_of_day) AS hour_of_day FROM plays GROUP BY 1"""
    ),
    "dq12_feature_inventory": over_features(_INVENTORY),
    "rt4_entity_segment": over_features(
        "SELECT DISTINCT track_uri, user_play_count AS play_count, user_skip_rate AS skip_rate, user_avg_engagement AS avg_engagement, user_segment FROM features"
    ),
} | {key: _cols(f"{text} AS result") for key, text in SCALARS.items()}
