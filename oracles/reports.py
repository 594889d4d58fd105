"""Aggregate reports, pivots, trends, retention and KPI tables."""

from oracles.base import (
    HOURS, MINUTES, MS, PCT, PCT3, PLAYS, SECONDS, SHUF, SHUF3, SKIP, SKIP3, SKIP_PCT, STATS, over_plays, r, re,
    rs, sql, xavg,
)

SKIPS = "count(*) FILTER (WHERE is_skip)"
RAW_SKIP = r("avg(CASE WHEN skipped THEN 1e0 ELSE 0e0 END) * 1e2")


def _dimension(label: str, expr: str, group: str | None) -> str:
    tail = f" GROUP BY {group}" if group else ""
    return f"SELECT '{label}' AS dimension, {expr} AS category, count(*) AS total_plays, {SKIPS} AS skips, {SKIP_PCT} AS skip_rate_pct FROM plays{tail}"


_BY_PLATFORM = _dimension("Platform", "platform", "platform")
_BY_TIME = _dimension("Time of Day", "time_of_day", "time_of_day")
_BY_SHUFFLE = _dimension("Shuffle Mode", "CASE WHEN shuffle THEN 'Shuffle On' ELSE 'Shuffle Off' END", "shuffle")
_BY_DAY = _dimension("Day of Week", "day_of_week", "day_of_week")

_GROUPED = f"""SELECT CASE WHEN grouping(platform) = 1 THEN 'ALL PLATFORMS' ELSE platform END AS platform,
 CASE WHEN grouping(time_of_day) = 1 THEN 'ALL TIMES' ELSE time_of_day END AS time_of_day, count(*) AS total_plays,
 {HOURS} AS total_hours, {SKIP_PCT} AS skip_rate_pct, {PCT} AS avg_percent_played FROM plays GROUP BY """

_DAYS = f"""days AS (SELECT date, count(*) AS daily_plays, {HOURS} AS daily_hours, {SKIP_PCT} AS daily_skip_rate FROM plays GROUP BY date)"""
_ACTIVITY = f"""days AS (SELECT date, count(*) AS daily_plays, {MS} / 3.6e6 AS daily_hours, {MS} / 6e4 AS daily_minutes, {SKIP3} AS daily_skip_rate
 FROM plays GROUP BY date)"""


def _with(extra: str, body: str) -> str:
    return sql(PLAYS + ",\n" + extra, body)


def _peaks(table: str, key: str, value: str) -> str:
    """Extremes with the smallest key on ties."""
    return f"""(SELECT CAST({key} AS VARCHAR) FROM {table} ORDER BY {value} DESC, {key} LIMIT 1) AS peak_key,
 CAST((SELECT max({value}) FROM {table}) AS DOUBLE) AS peak,
 (SELECT CAST({key} AS VARCHAR) FROM {table} ORDER BY {value}, {key} LIMIT 1) AS low_key,
 CAST((SELECT min({value}) FROM {table}) AS DOUBLE) AS low,
 {rs(f'(SELECT max({value}) * 1e0 FROM {table}) / (SELECT min({value}) FROM {table})', 4)} AS ratio"""


_RANKED_PLATFORMS = f"""pm AS (SELECT platform, {re(f'{MS} / 1e3 / count(*)')} AS sec, {SKIP3} AS skip_rate, {PCT3} AS pct FROM plays GROUP BY 1),
ps AS (SELECT platform, (pct / max(pct) OVER () * 0.4e0 + (1 - skip_rate) / max(1 - skip_rate) OVER () * 0.4e0
  + sec / max(sec) OVER () * 0.2e0) * 100 AS engagement_score FROM pm),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY engagement_score DESC, platform) AS INTEGER) AS rank FROM ps)"""

_ARTISTS = f"""SELECT artist_name, total_plays, unique_tracks, total_seconds, skip_rate, avg_percent_played, shuffle_rate,
 total_seconds / 3600 AS total_hours,
 (avg_percent_played / max(avg_percent_played) OVER () * 0.4e0 + (1 - skip_rate) / max(1 - skip_rate) OVER () * 0.4e0
  + total_plays / CAST(max(total_plays) OVER () AS DOUBLE) * 0.2e0) * 100 AS engagement_score FROM (
 SELECT artist_name, count(*) AS total_plays, count(DISTINCT track_name) AS unique_tracks, {re(f'{MS} / 1e3')} AS total_seconds,
  {SKIP3} AS skip_rate, {PCT3} AS avg_percent_played, {SHUF3} AS shuffle_rate FROM plays GROUP BY 1 HAVING count(*) >= 20)"""

_ARTIST_METRICS = f"""am AS (SELECT artist_name, count(*) AS total_plays, {HOURS} AS total_hours, {SKIP_PCT} AS skip_rate_pct,
 {PCT} AS avg_percent_played, count(DISTINCT track_name) AS unique_tracks FROM plays GROUP BY 1 HAVING count(*) >= 10)"""


def _pivot(rows: str, col: str, values: tuple, prefix: str = "") -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else f"'{v}'"
    cells = ", ".join(f'count(*) FILTER (WHERE {col} = {lit(v)}) AS "{prefix}{v}"' for v in values)
    return over_plays(f"SELECT {rows}, {cells} FROM plays GROUP BY {rows}")


_ODD = """(SELECT * REPLACE (CASE event_id % 10 WHEN 3 THEN 'cast to device' WHEN 7 THEN NULL ELSE platform END AS platform) FROM plays)"""


def _pivot_share(rows: str, col: str, values: tuple) -> str:
    inside = ", ".join(f"'{v}'" for v in values)
    total = f"count(*) FILTER (WHERE {col} IN ({inside}))"
    cells = ", ".join(
        r(f"count(*) FILTER (WHERE {col} = '{v}') * 1e2 / {total}", 4) + f' AS "{v}"' for v in values
    )
    return over_plays(f"SELECT {rows}, {cells} FROM plays GROUP BY {rows}")


PLATFORMS = ("android", "iOS", "mac", "web player", "windows")
PARTS = ("Morning", "Afternoon", "Evening", "Night")

_CORR = {
    "hour_of_day": "hour_of_day", "day_of_week_num": "day_of_week_num", "estimated_track_length_ms": "estimated_track_length_ms",
    "shuffle": SHUF,
} | {f"platform_{p}": f"CASE WHEN platform = '{p}' THEN 1e0 ELSE 0e0 END" for p in PLATFORMS}
_CORRELATIONS = " UNION ALL ".join(f"SELECT '{n}' AS feature, corr({x}, {SKIP}) AS c FROM plays" for n, x in _CORR.items())


def _d1(x: str) -> str:
    return f"CAST(CAST({r(x)} AS DECIMAL(20,1)) AS VARCHAR)"


def _whole(x: str) -> str:
    return f"CAST(CAST(floor(({x}) * 1e0 + 0.5e0) AS BIGINT) AS VARCHAR)"


def _comma(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def _share(p: str) -> str:
    return f"avg(CASE WHEN platform = '{p}' THEN 1e0 ELSE 0e0 END)"


def _metrics(rows: list[tuple[str, str, str]]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{n}' AS metric, {v} AS value FROM {t}" for n, v, t in rows)


_TENTHS = f"CAST(floor({MS} / 3.6e6 * 10 + 0.5e0) AS BIGINT)"
_SUM = f"{MS} / 3.6e6"
_LENGTH = "CAST(sum(CAST(round_even(CAST(session_duration_minutes * 1e1 AS DOUBLE), 0) AS BIGINT)) AS BIGINT) / 1e1 / count(*)"

KPI = _metrics([
    ("Total Streams", "CAST(count(*) AS VARCHAR)", "plays"),
    ("Content Catalog", "count(DISTINCT track_uri) || ' tracks, ' || count(DISTINCT artist_name) || ' artists'", "plays"),
    ("Total Listening Hours", _whole(_SUM) + " || ' hours'", "plays"),
    ("Skip Rate", _d1(f"avg({SKIP}) * 1e2") + " || '%'", "plays"),
    ("Completion Rate", _d1(xavg("percent_played")) + " || '%'", "plays"),
    ("Daily Avg Streams", _whole("count(*) / CAST(count(DISTINCT date) AS DOUBLE)"), "plays"),
])
EDA = _metrics([
    ("Total Listening Hours", f"{_comma(f'{_TENTHS} // 10')} || '.' || ({_TENTHS} % 10)", "plays"),
    ("Total Tracks Played", _comma("count(*)"), "plays"),
    ("Unique Tracks", _comma("count(DISTINCT track_uri)"), "plays"),
    ("Unique Artists", _comma("count(DISTINCT artist_name)"), "plays"),
    ("Total Sessions", _comma("count(*)"), "stats"),
    ("Avg Daily Sessions", _d1("count(*) / CAST(count(DISTINCT CAST(session_start AS DATE)) AS DOUBLE)"), "stats"),
    ("Avg Session Length (min)", _d1(_LENGTH), "stats"),
    ("Avg Tracks per Session", _d1("avg(tracks_count)"), "stats"),
    ("Overall Skip Rate", _d1(f"avg({SKIP}) * 1e2") + " || '%'", "plays"),
    ("Avg Percent Played", _d1(xavg("percent_played")) + " || '%'", "plays"),
    ("Platform Distribution",
     f"'Web: ' || {_d1(_share('web player') + ' * 1e2')} || '%, iOS: ' || {_d1(_share('iOS') + ' * 1e2')} || '%, Android: ' || {_d1(_share('android') + ' * 1e2')} || '%'",
     "plays"),
])
EXEC = _metrics([
    ("Total Streaming Events", _comma("count(*)"), "plays"),
    ("Total Content Hours", _comma(f"floor({_SUM} + 0.5e0)"), "plays"),
    ("Revenue Proxy ($)", "'$' || " + _comma(f"floor({_SUM} * 0.004e0 + 0.5e0)"), "plays"),
    ("Platform Market Share", f"'Web: ' || {_whole(_share('web player') + ' * 1e2')} || '%'", "plays"),
    ("Average Session Length", _d1(_LENGTH) + " || ' min'", "stats"),
    ("Overall Skip Rate", _d1(f"avg({SKIP}) * 1e2") + " || '%'", "plays"),
    ("Peak Usage Hour", "hour_of_day || ':00'", "(SELECT hour_of_day FROM plays GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
    ("Top Platform (Engagement)", "platform", "ranked WHERE rank = 1"),
    ("High Quality Sessions", _d1("count(*) FILTER (WHERE quality_category = 'High') * 1e2 / count(quality_category)") + " || '%'", "scored"),
    ("Content Catalog", _comma("count(DISTINCT track_uri)") + " || ' tracks'", "plays"),
])

_CHURN = f"""{_ACTIVITY},
back AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS b FROM days),
parts AS (SELECT avg(daily_plays) FILTER (WHERE b <= 7) AS recent,
  CASE WHEN count(*) >= 14 THEN avg(daily_plays) FILTER (WHERE b BETWEEN 8 AND 14) ELSE avg(daily_plays) FILTER (WHERE b <= 7) END AS before FROM back),
churn AS (SELECT recent, before, CASE WHEN before > 0 THEN (recent - before) / before ELSE 0e0 END AS trend FROM parts)"""

_D4 = "CAST(CAST({x} AS DECIMAL(20,4)) AS VARCHAR)"


def _d4(x: str) -> str:
    return _D4.format(x=r(x, 4))


def _rule(name: str, fired: str, value: str, table: str) -> str:
    return f"SELECT '{name}' AS rule, {fired} AS fired, {value} AS value FROM {table}"


_WORST = "(SELECT {k} FROM plays GROUP BY 1 ORDER BY " + SKIP3 + " DESC, 1 LIMIT 1)"
_HOURS = "(SELECT hour_of_day, count(*) AS n FROM plays GROUP BY 1)"
INSIGHTS = "\nUNION ALL ".join([
    _rule("invest in platform", "true", "platform", "ranked WHERE rank = 1"),
    _rule("optimise platform", "true", "platform", "ranked WHERE rank = (SELECT max(rank) FROM ranked)"),
    _rule("improve shuffle", f"avg({SKIP}) FILTER (WHERE shuffle) > avg({SKIP}) FILTER (WHERE NOT shuffle)",
          _d4(f"avg({SKIP}) FILTER (WHERE shuffle)"), "plays"),
    _rule("focus on part of day", "true", "lower(time_of_day)", _WORST.format(k="time_of_day")),
    _rule("average session score", "true", _d4(xavg("session_quality_score")), "scored"),
    _rule("low quality sessions pct", "true", _d4("avg(CASE WHEN session_quality_score < 33 THEN 1e0 ELSE 0e0 END) * 1e2"), "scored"),
    _rule("scale for peak hour", "true", "hour_of_day || ':00'", f"(SELECT hour_of_day FROM {_HOURS} ORDER BY n DESC, 1 LIMIT 1)"),
    _rule("peak to low ratio", "true", _d4(f"max(n) * 1e0 / min(n)"), _HOURS),
    _rule("off-peak promotion", "true", "hour_of_day || ':00-' || ((hour_of_day + 2) % 24) || ':00'",
          f"(SELECT hour_of_day FROM {_HOURS} ORDER BY n, 1 LIMIT 1)"),
    _rule("target skip rate", "true", _d4(f"avg({SKIP}) * 0.9e0"), "plays"),
    _rule("target session minutes", "true", _d4("avg(session_duration_minutes) * 1.15e0"), "stats"),
    _rule("re-engage", "trend < -0.1e0", _D4.format(x=rs("trend", 4)), "churn"),
    _rule("improve daily retention", "rate < 0.7e0", _D4.format(x="rate"),
          "(SELECT " + r("count(*) / CAST(date_diff('day', min(date), max(date)) + 1 AS DOUBLE)", 4) + " AS rate FROM days)"),
    _rule("highest skip platform", "true", "platform", _WORST.format(k="platform")),
])

_RISK = f"""SELECT p.* EXCLUDE (track_length_seconds), track_play_count, historical_skip_rate, h.track_length_seconds, user_total_plays, user_skip_tendency,
 user_avg_completion, preferred_platform,
 CASE WHEN historical_skip_rate > 70 THEN 'High Risk' WHEN historical_skip_rate > 40 THEN 'Medium Risk' ELSE 'Low Risk' END AS track_skip_risk,
 CASE WHEN user_skip_tendency > 60 THEN 'High Skip User' WHEN user_skip_tendency > 30 THEN 'Medium Skip User' ELSE 'Low Skip User' END AS user_skip_profile
 FROM plays p
 JOIN (SELECT track_uri, track_name, artist_name, count(*) AS track_play_count, {SKIP_PCT} AS historical_skip_rate,
   max(estimated_track_length_ms) / 1e3 AS track_length_seconds FROM plays GROUP BY ALL) h
   ON h.track_uri = p.track_uri AND h.track_name = p.track_name AND h.artist_name = p.artist_name
 JOIN (SELECT track_uri, count(*) AS user_total_plays, {SKIP_PCT} AS user_skip_tendency, {PCT} AS user_avg_completion,
   mode() WITHIN GROUP (ORDER BY platform) AS preferred_platform FROM plays GROUP BY 1) u ON u.track_uri = p.track_uri
 ORDER BY "timestamp" DESC, event_id DESC LIMIT 1000"""

_TOP_TRACKS = f"""SELECT track_name, artist_name, count(*) AS play_count, {MINUTES} AS total_minutes, {PCT} AS avg_percent_played,
 {SKIP_PCT} AS skip_rate_pct FROM plays GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY play_count DESC, track_name, artist_name LIMIT 20"""


def _leaders(by: str, k: int) -> str:
    return over_plays(
        f"""SELECT artist_name, count(*) AS total_plays, count(DISTINCT track_name) AS unique_tracks, {re(f'{MS} / 1e3', 2)} AS total_seconds,
 {re(f'avg({SKIP})', 2)} AS skip_rate, {re(xavg('percent_played'), 2)} AS avg_percent_played, {re(f'{MS} / 3.6e6', 1)} AS total_hours
 FROM plays GROUP BY 1 ORDER BY {by} DESC, 1 LIMIT {k}"""
    )


def _extremes(direction: str) -> str:
    return over_plays(
        f"SELECT artist_name, count(*) AS total_plays, {SKIPS} AS total_skips, {SKIP3} AS skip_rate FROM plays GROUP BY 1 HAVING count(*) >= 10 ORDER BY skip_rate {direction}, 1 LIMIT 10"
    )


TEXTS = {
    "snk2_write_report": over_plays(_TOP_TRACKS),
    "ag1_top_tracks": over_plays(_TOP_TRACKS),
    "ag1_listening_time_leaders": over_plays(
        f"""SELECT track_name, artist_name, count(*) AS play_count, {re(f'{MS} / 1e3', 2)} AS total_seconds, {re(f'avg({SKIP})', 2)} AS skip_rate,
 {re(xavg('percent_played'), 2)} AS avg_percent_played, {re(f'{MS} / 6e4', 1)} AS total_minutes FROM plays GROUP BY 1, 2
 ORDER BY total_minutes DESC, track_name, artist_name LIMIT 15"""
    ),
    "ag2_top_artists": over_plays(
        f"""SELECT artist_name, count(*) AS total_plays, count(DISTINCT track_name) AS unique_tracks, {HOURS} AS total_hours,
 {SECONDS} AS avg_seconds_per_play, {SKIP_PCT} AS skip_rate_pct FROM plays GROUP BY 1 HAVING count(*) >= 10
 ORDER BY total_hours DESC, artist_name LIMIT 15"""
    ),
    "ag2_artist_leaders": _leaders("total_plays", 15),
    "ag2_artist_leaders_by_hours": _leaders("total_hours", 10),
    "ag3_platform_report": over_plays(
        f"""SELECT platform, count(*) AS total_plays, {r('count(*) * 1e2 / sum(count(*)) OVER ()')} AS market_share_pct, {HOURS} AS total_hours,
 {SECONDS} AS avg_seconds_per_play, {SKIP_PCT} AS skip_rate_pct, {PCT} AS avg_percent_played FROM plays GROUP BY 1"""
    ),
    "ag3_platform_table": over_plays(
        f"""SELECT platform, count(*) AS total_plays, {re(f'{MS} / 1e3')} AS total_seconds, {re(f'{MS} / 1e3 / count(*)')} AS avg_seconds_per_play,
 {SKIP3} AS skip_rate, {PCT3} AS avg_percent_played, {SHUF3} AS shuffle_rate FROM plays GROUP BY 1"""
    ),
    "ag4_platform_by_time": over_plays(
        f"""SELECT time_of_day, platform, count(*) AS plays, {r('count(*) * 1e2 / sum(count(*)) OVER (PARTITION BY time_of_day)')} AS platform_share_pct
 FROM plays GROUP BY 1, 2"""
    ),
    "ag5_hourly": over_plays(
        f"SELECT hour_of_day, count(*) AS total_plays, {HOURS} AS total_hours, {SKIP_PCT} AS skip_rate_pct, {PCT} AS avg_percent_played FROM plays GROUP BY 1"
    ),
    "ag6_weekday": over_plays(
        f"SELECT day_of_week, count(*) AS total_plays, {HOURS} AS total_hours, {SECONDS} AS avg_seconds_per_play, {SKIP_PCT} AS skip_rate_pct FROM plays GROUP BY 1"
    ),
    "ag7_monthly": over_plays("SELECT month, count(*) AS plays FROM plays GROUP BY 1"),
    "ag7_by_time": over_plays("SELECT time_of_day, count(*) AS plays FROM plays GROUP BY 1"),
    "ag8_skip_by_dimension": over_plays(
        f"SELECT 'Overall' AS dimension, 'All' AS category, count(*) AS total_plays, {SKIPS} AS skips, {SKIP_PCT} AS skip_rate_pct FROM plays UNION ALL {_BY_PLATFORM} UNION ALL {_BY_TIME} UNION ALL {_BY_SHUFFLE}"
    ),
    "ag8_skip_drivers": over_plays(f"{_BY_PLATFORM} UNION ALL {_BY_TIME} UNION ALL {_BY_SHUFFLE} UNION ALL {_BY_DAY}"),
    "ag9_most_skipped_tracks": over_plays(
        f"""SELECT track_name, artist_name, count(*) AS total_plays, {SKIPS} AS total_skips, {SKIP_PCT} AS skip_rate_pct, {PCT} AS avg_percent_played
 FROM plays GROUP BY 1, 2 HAVING count(*) >= 10 ORDER BY skip_rate_pct DESC, total_plays DESC, track_name, artist_name LIMIT 15"""
    ),
    "ag10_most_skipped_artists": _extremes("DESC"),
    "ag10_least_skipped_artists": _extremes("ASC"),
    "ag11_daily": over_plays(
        f"SELECT date, count(*) AS daily_plays, count(DISTINCT track_uri) AS unique_tracks, {HOURS} AS daily_hours, {SECONDS} AS avg_seconds_per_play, {SKIP_PCT} AS daily_skip_rate FROM plays GROUP BY 1"
    ),
    "ag12_weekly": over_plays(
        f"""SELECT CAST(date_trunc('week', "timestamp") AS DATE) AS week, count(*) AS weekly_plays, {re(f'{MS} / 1e3')} AS weekly_seconds,
 {MS} / 3.6e6 AS weekly_hours, count(DISTINCT date) AS active_days FROM plays GROUP BY 1"""
    ),
    "ag12_weekly_from_daily": _with(
        _ACTIVITY,
        f"""SELECT CAST(date_trunc('week', date) AS DATE) AS week, count(*) AS active_days_per_week, CAST(sum(daily_plays) AS BIGINT) AS total_weekly_plays,
 {re('avg(daily_plays)', 2)} AS avg_daily_plays, {re('sum(daily_minutes)', 2)} AS total_weekly_minutes, {re('avg(daily_minutes)', 2)} AS avg_daily_minutes,
 {re('avg(daily_skip_rate)', 2)} AS avg_weekly_skip_rate FROM days GROUP BY 1""",
    ),
    "ag13_quality_distribution": over_plays(
        f"""SELECT listening_quality, count(*) AS plays, {r('count(*) * 1e2 / sum(count(*)) OVER ()')} AS percentage, {SECONDS} AS avg_seconds,
 {PCT} AS avg_percent_played FROM plays GROUP BY 1"""
    ),
    "ag14_skip_summary": over_plays(
        f"""SELECT count(*) AS total, {SKIPS} AS skipped, {SKIP_PCT} AS skip_rate, {PCT} AS avg_pct_all,
 {r(xavg('CASE WHEN NOT is_skip THEN percent_played END'))} AS avg_pct_non_skip, {r(xavg('CASE WHEN is_skip THEN percent_played END'))} AS avg_pct_skip FROM plays"""
    ),
    "ag15_skip_by_reason_end": over_plays(f"SELECT reason_end, count(*) AS plays, {SKIP_PCT} AS skip_rate FROM plays GROUP BY 1"),
    "ag16_journey_matrix": over_plays(
        f"""SELECT reason_start, reason_end, count(*) AS "count", {SKIP3} AS skip_rate, {PCT3} AS avg_percent_played FROM plays GROUP BY 1, 2
 HAVING count(*) >= 100 ORDER BY 3 DESC, 1, 2 LIMIT 10"""
    ),
    "ag17_discovery": over_plays(f'SELECT reason_start, count(*) AS "count", {SKIP3} AS skip_rate, {PCT3} AS avg_percent_played FROM plays GROUP BY 1'),
    "ag18_length_vs_skip": over_plays(
        f"""SELECT c.track_length_category, skip_rate, coalesce(n, 0) AS "count", avg_percent_played
 FROM (VALUES ('<2min'), ('2-3min'), ('3-4min'), ('4-5min'), ('5min+')) c(track_length_category)
 LEFT JOIN (SELECT track_length_category, {SKIP3} AS skip_rate, count(*) AS n, {PCT3} AS avg_percent_played FROM plays GROUP BY 1) t
 ON t.track_length_category = c.track_length_category"""
    ),
    "ag25_rollup_report": over_plays(_GROUPED + "ROLLUP (platform, time_of_day)"),
    "ag26_cube_report": over_plays(_GROUPED + "CUBE (platform, time_of_day)"),
    "ag27_kpi_table": over_plays(KPI),
    "ag28_eda_kpis": sql(STATS, EDA),
    "ag29_executive_summary": sql(STATS + ",\n" + _RANKED_PLATFORMS, EXEC),
    "ag30_overview": over_plays(
        f"""SELECT count(*) AS plays, {HOURS} AS hours, count(DISTINCT track_name) AS tracks, count(DISTINCT artist_name) AS artists,
 {RAW_SKIP} AS raw_skip_rate, {SECONDS} AS avg_seconds,
 strftime(min("timestamp"), '%Y-%m-%d') || ' to ' || strftime(max("timestamp"), '%Y-%m-%d') AS date_range,
 CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 8.64e10) AS BIGINT) AS span_days FROM plays"""
    ),
    "ag31_raw_skip_by_platform": over_plays(
        f"SELECT platform, count(*) AS total_plays, count(*) FILTER (WHERE skipped) AS skips, {RAW_SKIP} AS skip_rate FROM plays GROUP BY 1"
    ),
    "ag31_raw_skip_by_hour": over_plays(
        f"SELECT hour_of_day, count(*) AS total_plays, count(*) FILTER (WHERE skipped) AS skips, {RAW_SKIP} AS skip_rate FROM plays GROUP BY 1"
    ),
    "ag32_peak_report": _with(
        f"""h AS (SELECT hour_of_day, count(*) AS n, {SKIP3} AS rate FROM plays GROUP BY 1), d AS (SELECT day_of_week, count(*) AS n FROM plays GROUP BY 1),
p AS (SELECT platform, count(*) AS n FROM plays GROUP BY 1)""",
        f"""SELECT 'plays by hour_of_day' AS measure, {_peaks('h', 'hour_of_day', 'n')}
UNION ALL SELECT 'plays by day_of_week', {_peaks('d', 'day_of_week', 'n')}
UNION ALL SELECT 'plays by platform', {_peaks('p', 'platform', 'n')}
UNION ALL SELECT 'skip rate by hour_of_day', {_peaks('h', 'hour_of_day', 'rate')}""",
    ),
    "ag33_platform_engagement": _with(_RANKED_PLATFORMS, f"SELECT platform, {r('engagement_score', 6)} AS engagement_score, rank FROM ranked"),
    "ag34_artist_performance": _with(
        f"ap AS ({_ARTISTS})", f"SELECT * REPLACE ({r('engagement_score', 6)} AS engagement_score) FROM ap"
    ),
    "ag35_skip_correlations": over_plays(f"SELECT feature, {rs('c', 6)} AS corr FROM ({_CORRELATIONS}) WHERE abs(c) > 0.01 AND NOT isnan(c)"),
    "ag36_dispersion_daily": _with(
        _ACTIVITY,
        f"SELECT {rs('avg(daily_plays)', 4)} AS mean, max(daily_plays) AS max, min(daily_plays) AS min, {rs('stddev_samp(daily_plays)', 4)} AS stddev, {rs('stddev_samp(daily_plays) / avg(daily_plays)', 4)} AS cv FROM days",
    ),
    "ag36_dispersion_weekly": over_plays(
        f"""SELECT {rs('avg(n)', 4)} AS mean, max(n) AS max, min(n) AS min, {rs('stddev_samp(n)', 4)} AS stddev, {rs('stddev_samp(n) / avg(n)', 4)} AS cv
 FROM (SELECT count(*) AS n FROM plays GROUP BY date_trunc('week', "timestamp"))"""
    ),
    "ag38_switch_rate": over_plays(
        f"""SELECT {r("avg(CASE WHEN platform = prev THEN 0e0 ELSE 1e0 END)", 6)} AS rate
 FROM (SELECT platform, lag(platform) OVER (ORDER BY "timestamp", event_id) AS prev FROM plays)"""
    ),
    "pv1_weekday_hour": _pivot("day_of_week_num", "hour_of_day", tuple(range(24)), "h"),
    "pv2_platform_time_share": _pivot_share("platform", "time_of_day", PARTS),
    "pv3_hour_platform": over_plays(f"SELECT hour_of_day, platform, count(*) AS n FROM {_ODD} GROUP BY ALL"),
    "pv4_time_platform_share": over_plays(
        f"SELECT time_of_day, platform, count(*) AS n, {r('count(*) * 1e2 / sum(count(*)) OVER (PARTITION BY time_of_day)', 4)} AS share FROM {_ODD} GROUP BY time_of_day, platform"
    ),
    "wn1_trailing_avg": _with(
        _DAYS,
        f"""SELECT date, daily_plays, {rs('avg(daily_plays) OVER w')} AS rolling_7d_plays, daily_hours, {rs('avg(daily_hours) OVER w')} AS rolling_7d_hours,
 daily_skip_rate, {rs('avg(daily_skip_rate) OVER w')} AS rolling_7d_skip_rate,
 {rs('(daily_plays - lag(daily_plays, 7) OVER (ORDER BY date)) * 1e2 / nullif(lag(daily_plays, 7) OVER (ORDER BY date), 0)')} AS wow_plays_growth
 FROM days WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    ),
    "wn2_centred_avg": _with(
        _ACTIVITY,
        f"""SELECT date, daily_plays, daily_hours, CASE WHEN count(*) OVER w = 7 THEN {rs('avg(daily_plays) OVER w', 4)} END AS rolling_plays,
 CASE WHEN count(*) OVER w = 7 THEN {rs('avg(daily_hours) OVER w', 4)} END AS rolling_hours
 FROM days WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    ),
    "wn2_retention_table": _with(
        _ACTIVITY,
        f"""SELECT date, daily_plays, {r('daily_minutes', 6)} AS daily_minutes, daily_skip_rate, CAST(date_trunc('week', date) AS DATE) AS week,
 CASE WHEN count(*) OVER w = 7 THEN {rs('avg(daily_plays) OVER w', 4)} END AS rolling_7d_plays,
 CASE WHEN count(*) OVER w = 7 THEN {rs('avg(daily_minutes) OVER w', 4)} END AS rolling_7d_minutes
 FROM days WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    ),
    "wn3_pct_change": _with(
        _DAYS,
        f"""SELECT date, daily_plays, lag(daily_plays) OVER (ORDER BY date) AS prev_day_plays,
 {rs('(daily_plays - lag(daily_plays) OVER (ORDER BY date)) * 1e2 / nullif(lag(daily_plays) OVER (ORDER BY date), 0)')} AS dod_plays_change FROM days""",
    ),
    "wn4_artist_ranking": _with(
        _ARTIST_METRICS,
        f"""SELECT artist_name, total_plays, CAST(rank() OVER (ORDER BY total_plays DESC) AS INTEGER) AS plays_rank, CAST(ntile(5) OVER (ORDER BY total_plays, artist_name) AS INTEGER) AS plays_quintile,
 total_hours, CAST(rank() OVER (ORDER BY total_hours DESC) AS INTEGER) AS hours_rank, skip_rate_pct, CAST(rank() OVER (ORDER BY skip_rate_pct) AS INTEGER) AS engagement_rank,
 {r('percent_rank() OVER (ORDER BY skip_rate_pct DESC) * 1e2')} AS skip_rate_percentile, unique_tracks,
 {r('(percent_rank() OVER (ORDER BY total_plays) * 0.3e0 + percent_rank() OVER (ORDER BY avg_percent_played) * 0.4e0 + percent_rank() OVER (ORDER BY skip_rate_pct DESC) * 0.3e0) * 1e2')} AS engagement_score
 FROM am ORDER BY engagement_score DESC, artist_name LIMIT 20""",
    ),
    "wn5_share": over_plays(
        f"SELECT artist_name, platform, count(*) AS plays, {r('count(*) * 1e2 / sum(count(*)) OVER (PARTITION BY artist_name)', 4)} AS pct FROM plays GROUP BY 1, 2"
    ),
    "wn6_first_in_group": over_plays(
        """SELECT platform, date, count(DISTINCT track_uri) AS tracks, first_value(count(DISTINCT track_uri)) OVER (PARTITION BY platform ORDER BY date) AS base
 FROM plays GROUP BY 1, 2"""
    ),
    "wn7_delta": over_plays(
        f"SELECT hour_of_day, rate, {rs('rate - lag(rate) OVER (ORDER BY hour_of_day)')} AS change FROM (SELECT hour_of_day, {SKIP_PCT} AS rate FROM plays GROUP BY 1)"
    ),
    "rt1_cohort_retention": over_plays(
        f"""SELECT CAST(cohort AS DATE) AS cohort_week, CAST(date_diff('day', cohort, wk) // 7 AS BIGINT) AS weeks_since_first, count(DISTINCT track_uri) AS active_users,
 {r("count(DISTINCT track_uri) * 1e2 / first_value(count(DISTINCT track_uri)) OVER (PARTITION BY cohort ORDER BY date_diff('day', cohort, wk) // 7)")} AS retention_rate
 FROM (SELECT track_uri, date_trunc('week', "timestamp") AS wk, min(date_trunc('week', "timestamp")) OVER (PARTITION BY track_uri) AS cohort FROM plays)
 WHERE date_diff('day', cohort, wk) // 7 <= 8 GROUP BY cohort, date_diff('day', cohort, wk) // 7"""
    ),
    "rt1_cohort_retention_by_user": over_plays(
        f"""SELECT CAST(cohort AS DATE) AS cohort_week, CAST(date_diff('day', cohort, wk) // 7 AS BIGINT) AS weeks_since_first, count(DISTINCT user_id) AS active_users,
 {r("count(DISTINCT user_id) * 1e2 / first_value(count(DISTINCT user_id)) OVER (PARTITION BY cohort ORDER BY date_diff('day', cohort, wk) // 7)")} AS retention_rate
 FROM (SELECT user_id, date_trunc('week', "timestamp") AS wk, min(date_trunc('week', "timestamp")) OVER (PARTITION BY user_id) AS cohort FROM plays)
 WHERE date_diff('day', cohort, wk) // 7 <= 8 GROUP BY cohort, date_diff('day', cohort, wk) // 7"""
    ),
    "rt2_daily_retention": over_plays(
        f"""SELECT CAST(date_diff('day', min(date), max(date)) + 1 AS INTEGER) AS total_days, count(DISTINCT date) AS active_days,
 {r("count(DISTINCT date) / CAST(date_diff('day', min(date), max(date)) + 1 AS DOUBLE)", 4)} AS retention_rate FROM plays"""
    ),
    "rt3_churn_trend": _with(
        _CHURN,
        f"""SELECT {r('recent', 4)} AS recent_avg, {r('before', 4)} AS previous_avg, {rs('trend', 4)} AS trend,
 CASE WHEN trend < -0.2e0 THEN 'High' WHEN trend < -0.1e0 THEN 'Medium' ELSE 'Low' END AS churn_risk FROM churn""",
    ),
    "rt5_skip_risk": over_plays(_RISK),
    "rt7_insights": sql(STATS + ",\n" + _RANKED_PLATFORMS + ",\n" + _CHURN, INSIGHTS),
}
