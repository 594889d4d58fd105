"""Sources, sinks, cleaning and quality."""

from oracles.base import big, over_dirty, over_plays, over_sessions, r

RAW = "track_uri, ts, platform, ms_played, track_name, artist_name, album_name, reason_start, reason_end, shuffle, skipped"
NULL_PLATFORM = "nullif(platform, '') AS platform"
_RAW_LIST = RAW.split(", ")

_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_missing,"
    f" {r(f'count(*) FILTER (WHERE {c} IS NULL) * 1e2 / count(*)', 4)} AS pct_missing FROM dirty"
    for c in _RAW_LIST
)
_CARDINALITY = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM dirty" for c in _RAW_LIST)
_TOP = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
 CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}
 QUALIFY (SELECT count(DISTINCT {c}) FROM dirty) < 20 AND row_number() OVER (ORDER BY count(*) DESC, {c}) <= 5)"""
    for c in _RAW_LIST
)
_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS stddev,
 CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
 quantile_cont({c}, 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS max FROM plays"""
    for c in ("ms_played", "hour_of_day", "day_of_week_num")
)
_DESCRIBE_ALL = " UNION ALL ".join(
    [
        f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM plays) AS n, (SELECT count(DISTINCT {c}) FROM plays) AS n_unique, top, freq,
 CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS median,
 CAST(NULL AS DOUBLE) AS q3, CAST(NULL AS DOUBLE) AS max
 FROM (SELECT {v} AS top, count(*) AS freq FROM plays WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""
        for c in ("platform", "track_name", "artist_name", "album_name", "reason_start", "reason_end", "shuffle", "skipped", "timestamp")
        for v in (f'strftime("{c}", \'%Y-%m-%d %H:%M:%S\') || rtrim(rtrim(strftime("{c}", \'.%f\'), \'0\'), \'.\')' if c == "timestamp" else f"CAST({c} AS VARCHAR)",)
    ]
    + [f'SELECT "column", n, NULL, NULL, NULL, mean, stddev, min, q1, median, q3, max FROM ({_DESCRIBE})']
)
_IQR = """q AS (SELECT quantile_cont(ms_played, 0.25) AS q1, quantile_cont(ms_played, 0.75) AS q3 FROM {t}),
f AS (SELECT q1, q3, q1 - (q3 - q1) * 1.5e0 AS lo, q3 + (q3 - q1) * 1.5e0 AS hi FROM q)
SELECT q1, q3, lo, hi, (SELECT count(*) FROM {t}, f WHERE ms_played < lo OR ms_played > hi) AS n_outliers FROM f"""
_TRAIL = """SELECT 'loaded' AS step, count(*) AS n_rows FROM dirty
UNION ALL SELECT 'critical_present', count(*) FROM dirty WHERE track_uri IS NOT NULL AND ts IS NOT NULL AND ms_played IS NOT NULL
UNION ALL SELECT 'timestamp_parsed', count(*) FROM typed
UNION ALL SELECT 'duration_valid', count(*) FROM valid
UNION ALL SELECT 'deduplicated', count(*) FROM cleaned"""

TEXTS = {
    # CSV has one way to say nothing: an empty field is missing
    "src1_read_plays": over_dirty(
        f"SELECT CAST(event_id AS VARCHAR) AS event_id, {RAW.replace('platform', NULL_PLATFORM)} FROM dirty"
    ),
    "src1_quoted_csv": over_dirty(
        f"""SELECT CAST(event_id AS VARCHAR) AS event_id, {RAW.replace('platform', NULL_PLATFORM)}
 FROM (SELECT * REPLACE (CASE event_id % 4 WHEN 0 THEN '"' || track_name || '", Pt. 1' WHEN 1 THEN track_name || chr(10) || 'live, twice' ELSE track_name END AS track_name) FROM dirty)"""
    ),
    "src2_read_stage": over_sessions(
        'SELECT session_id, "timestamp", track_uri, platform, seconds_played, is_skip, time_of_day, day_of_week, event_id FROM sessions'
    ),
    "src3_validate_schema": over_dirty(
        "SELECT CAST(event_id AS VARCHAR) AS event_id, track_uri, ts, CAST(ms_played AS VARCHAR) AS ms_played FROM dirty"
    ),
    "snk1_write_stage": over_plays("SELECT event_id, date, platform, ms_played, is_skip, listening_quality FROM plays"),
    "snk5_audit_log": over_dirty(
        f"""SELECT 'rows' AS step, step AS metric, n_rows AS value FROM ({_TRAIL})
UNION ALL SELECT 'missing', "column", n_missing FROM ({_PROFILE})
UNION ALL SELECT 'outliers', 'capped', count(*) FROM typed WHERE ms_played > 900000
UNION ALL SELECT 'duplicates', 'exact', (SELECT count(*) FROM valid) - (SELECT count(*) FROM cleaned)"""
    ),
    "cl1_drop_critical_nulls": over_dirty(
        "SELECT event_id, track_uri, ts, ms_played FROM dirty WHERE track_uri IS NOT NULL AND ts IS NOT NULL AND ms_played IS NOT NULL"
    ),
    "cl2_fill_unknown": over_dirty(
        "SELECT event_id, coalesce(track_name, 'Unknown') AS track_name, artist_name, album_name, coalesce(reason_start, 'Unknown') AS reason_start, reason_end, platform FROM dirty"
    ),
    "cl3_to_bool": over_dirty(
        "SELECT event_id, upper(shuffle) IN ('TRUE', 'T') AS shuffle, upper(skipped) IN ('TRUE', 'T') AS skipped FROM dirty"
    ),
    "cl4_to_numeric": over_dirty("SELECT event_id, try_cast(ms_played AS DOUBLE) AS ms_played FROM dirty"),
    "cl5_clean_text": over_dirty(
        """SELECT event_id, CASE WHEN coalesce(trim(platform), '') = '' THEN 'Unknown' ELSE trim(platform) END AS platform,
 coalesce(trim(track_name), 'Unknown') AS track_name, coalesce(trim(reason_start), 'Unknown') AS reason_start FROM dirty"""
    ),
    "cl6_parse_ts": over_dirty(
        """SELECT event_id, try_strptime(ts, '%d-%m-%Y %H:%M') AS "timestamp" FROM dirty
 WHERE try_strptime(ts, '%d-%m-%Y %H:%M') IS NOT NULL"""
    ),
    "cl7_cap": over_dirty(
        "SELECT event_id, CASE WHEN try_cast(ms_played AS DOUBLE) > 900000 THEN 900000e0 ELSE try_cast(ms_played AS DOUBLE) END AS ms_played FROM dirty"
    ),
    "cl8_drop_negative": over_dirty(
        "SELECT event_id, try_cast(ms_played AS DOUBLE) AS ms_played FROM dirty WHERE try_cast(ms_played AS DOUBLE) >= 0"
    ),
    "cl9_dedupe": over_dirty("SELECT DISTINCT * FROM dirty"),
    "cl_clean": over_dirty("SELECT * FROM cleaned"),
    "dq1_null_profile": over_dirty(_PROFILE),
    "dq2_dup_count": over_dirty("SELECT (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates"),
    "dq3_near_dup_count": over_dirty(
        f"""SELECT {big('coalesce(sum(n), 0)')} AS near_duplicates FROM (
 SELECT count(*) AS n FROM dirty WHERE try_strptime(ts, '%d-%m-%Y %H:%M') IS NOT NULL GROUP BY track_uri, ts HAVING count(*) > 1)"""
    ),
    "dq4_cardinality": over_dirty(_CARDINALITY),
    "dq4_top_values": over_dirty(_TOP),
    "dq5_iqr_outliers": over_dirty("SELECT 1").replace("\nSELECT 1", ",\n" + _IQR.format(t="typed")),
    "dq6_ts_range": over_plays(
        """SELECT min("timestamp") AS first_ts, max("timestamp") AS last_ts,
 CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 8.64e10) AS BIGINT) AS days,
 count(*) FILTER (WHERE "timestamp" > TIMESTAMP '2024-01-21 00:00:00') AS n_future,
 count(*) FILTER (WHERE "timestamp" < TIMESTAMP '2024-01-05 00:00:00') AS n_too_old FROM plays"""
    ),
    "dq7_domain_violations": over_plays(
        "SELECT platform AS value, count(*) AS n FROM plays WHERE platform NOT IN ('web player', 'iOS', 'Android', 'desktop') GROUP BY 1"
    ),
    "dq8_rule_violations": over_dirty("SELECT count(*) AS violations FROM valid WHERE skipped AND ms_played > 240000"),
    "dq9_describe": over_plays(_DESCRIBE),
    "dq9_describe_all": over_plays(_DESCRIBE_ALL),
    "dq10_dataset_summary": over_dirty(
        f"""SELECT 'total_records' AS metric, CAST(count(*) AS VARCHAR) AS value FROM cleaned
UNION ALL SELECT 'date_range', strftime(min("timestamp"), '%Y-%m-%d') || ' to ' || strftime(max("timestamp"), '%Y-%m-%d') FROM cleaned
UNION ALL SELECT 'unique_tracks', CAST(count(DISTINCT track_uri) AS VARCHAR) FROM cleaned
UNION ALL SELECT 'unique_artists', CAST(count(DISTINCT artist_name) AS VARCHAR) FROM cleaned
UNION ALL SELECT 'total_listening_hours', CAST(CAST({r('sum(ms_played) / 3.6e6')} AS DECIMAL(20,1)) AS VARCHAR) FROM cleaned
UNION ALL SELECT 'skip_rate', CAST(CAST({r('avg(CAST(skipped AS DOUBLE)) * 1e2')} AS DECIMAL(20,1)) AS VARCHAR) || '%' FROM cleaned
UNION ALL SELECT 'avg_play_duration_seconds', CAST(CAST({r('sum(ms_played) / count(*) / 1e3')} AS DECIMAL(20,1)) AS VARCHAR) FROM cleaned
UNION ALL SELECT 'platform: ' || platform, CAST(count(*) AS VARCHAR) FROM cleaned GROUP BY platform"""
    ),
    "dq11_audit_trail": over_dirty(_TRAIL),
}
