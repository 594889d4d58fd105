"""Matrices, splits, weights, score measures and cluster tables for a given assignment."""

from oracles.base import MS, PCT3, SHUF3, SKIP3, over_plays, r, re, rs, sql, xavg, PLAYS
from oracles.features import ONE_HOT, over_features

_SKIP_FEATURES = (
    "hour_of_day", "day_of_week_num", "is_weekend", "is_peak_hour", "is_late_night", "track_length_seconds", "track_play_count",
    "track_skip_rate", "user_skip_rate", "user_avg_completion", "user_frequency", "session_track_count",
    "track_position_in_session", "session_skip_rate", "platform_encoded", "time_of_day_encoded", "shuffle", "artist_skip_rate",
    "artist_play_count", "is_autoplay", "is_manual_start", "prev_track_skip", "rolling_5_skip_rate",
)
_BASIC = (
    "hour_of_day", "day_of_week_num", "is_weekend", "is_peak_hour", "is_night", "track_length_seconds", "is_long_track",
    "is_short_track", "shuffle_int", "platform_iOS", "platform_web player", "reason_start_clickrow", "reason_start_trackdone",
    "reason_start_autoplay",
)


def _doubles(names: tuple) -> str:
    return ", ".join(f'coalesce(CAST("{n}" AS DOUBLE), 0e0) AS "{n}"' for n in names)


_U = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000"
_HOT = f"hot AS (SELECT * EXCLUDE (is_skip), is_skip, {ONE_HOT} FROM plays)"
_STATS = " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, {rs(f'avg(CAST("{n}" AS DOUBLE))', 6)} AS mean, {rs(f'stddev_pop(CAST("{n}" AS DOUBLE))', 6)} AS std FROM hot"""
    for n in _BASIC
)

SCORED = PLAYS + """,
scored AS (
  SELECT event_id, CAST(is_skip AS INTEGER) AS label, 1 - completion_score AS score,
    CASE WHEN 1 - completion_score > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM plays),
ranked AS (
  SELECT label, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0) AS rank FROM scored),
totals AS (SELECT CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS n FROM scored)"""

_METRICS = f"""SELECT {r('(SELECT avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END) FROM scored)', 6)} AS accuracy,
 {r('((SELECT sum(rank) FROM ranked WHERE label = 1) - p * (p + 1) / 2) / (p * n)', 6)} AS auc FROM totals"""

_PER_CLASS = f"""SELECT c AS "class", {r('coalesce(hit / nullif(called, 0), 0e0)', 6)} AS "precision", {r('coalesce(hit / nullif(support, 0), 0e0)', 6)} AS recall,
 {r('coalesce(2e0 * hit / nullif(called + support, 0), 0e0)', 6)} AS f1, support
 FROM (SELECT c, CAST(count(*) FILTER (WHERE label = c AND prediction = c) AS DOUBLE) AS hit, count(*) FILTER (WHERE prediction = c) AS called,
   count(*) FILTER (WHERE label = c) AS support FROM scored, (VALUES (0), (1)) v(c) GROUP BY c)"""

ASSIGNED = PLAYS + f""",
prof AS (
  SELECT *, total_seconds / 60 AS total_minutes, avg_percent_played * (1 - skip_rate) AS engagement_score FROM (
  SELECT track_uri, CAST(split_part(track_uri, ':', 2) AS INTEGER) % 4 AS cluster, count(*) AS play_count, {re(f'{MS} / 1e3')} AS total_seconds,
   {re(f'{MS} / 1e3 / count(*)')} AS avg_seconds_per_play, {SKIP3} AS skip_rate, {PCT3} AS avg_percent_played, {SHUF3} AS shuffle_rate
  FROM plays GROUP BY track_uri HAVING count(*) >= 3)),
tab AS (
  SELECT cluster, count(*) AS cluster_size, {r('count(*) * 1e2 / sum(count(*)) OVER ()')} AS share, {re(xavg('play_count'))} AS avg_play_count,
   {re(xavg('avg_seconds_per_play'))} AS avg_seconds_per_play, {re(xavg('skip_rate'))} AS avg_skip_rate,
   {re(xavg('avg_percent_played'))} AS avg_percent_played, {re(xavg('shuffle_rate'))} AS avg_shuffle_rate,
   {re(xavg('engagement_score'))} AS avg_engagement_score, {re(xavg('total_minutes'))} AS avg_total_minutes
  FROM prof GROUP BY cluster)"""

TEXTS = {
    "ml1_skip_matrix": over_features(f"SELECT event_id, CAST(is_skip AS INTEGER) AS label, {_doubles(_SKIP_FEATURES)} FROM features"),
    "ml2_skip_matrix_basic": sql(PLAYS + ",\n" + _HOT, f"SELECT event_id, CAST(is_skip AS INTEGER) AS label, {_doubles(_BASIC)} FROM hot"),
    "ml3_split": over_plays(
        f"""SELECT event_id, label, before < n * 0.2e0 AS is_test FROM (
 SELECT *, count(*) OVER (PARTITION BY label) AS n,
  count(*) OVER (PARTITION BY label ORDER BY u RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY label, u) AS before
 FROM (SELECT event_id, CAST(is_skip AS INTEGER) AS label, {_U} AS u FROM plays))"""
    ),
    "ml4_feature_stats": sql(PLAYS + ",\n" + _HOT, _STATS),
    "ml8_class_weights": over_plays(
        """SELECT CAST(is_skip AS INTEGER) AS label, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share,
 CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight FROM plays GROUP BY 1"""
    ),
    "ml9_binary_metrics": sql(SCORED, _METRICS),
    "snk3_write_json": sql(SCORED, _METRICS),
    "snk4_saved_agree": over_plays(
        f"""SELECT 'classifier' AS part, n, n AS n_same FROM (SELECT count(*) AS n FROM (
 SELECT *, count(*) OVER (PARTITION BY label) AS n,
  count(*) OVER (PARTITION BY label ORDER BY u RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY label, u) AS before
 FROM (SELECT CAST(is_skip AS INTEGER) AS label, {_U} AS u FROM plays)) WHERE before < n * 0.2e0)
 UNION ALL SELECT 'segments', n, n FROM (SELECT count(*) AS n FROM (SELECT track_uri FROM plays GROUP BY track_uri HAVING count(*) >= 5))"""
    ),
    "ml13_confusion": sql(SCORED, "SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2"),
    "ml13_report": sql(SCORED, _PER_CLASS),
    "ml14_roc": sql(
        SCORED,
        f"""SELECT score AS threshold, {r('fp / n', 6)} AS fpr, {r('tp / p', 6)} AS tpr FROM totals, (
 SELECT score, sum(count(*) FILTER (WHERE label = 0)) OVER (ORDER BY score DESC) AS fp,
  sum(count(*) FILTER (WHERE label = 1)) OVER (ORDER BY score DESC) AS tp FROM scored GROUP BY score)""",
    ),
    "ml14_roc_corners": sql(
        SCORED,
        f"""SELECT threshold, {r('fp / n', 6)} AS fpr, {r('tp / p', 6)} AS tpr FROM totals, (
 SELECT score AS threshold, CAST(sum(neg) OVER w AS DOUBLE) AS fp, CAST(sum(pos) OVER w AS DOUBLE) AS tp, pos, neg,
  lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, lag(pos) OVER w AS last_pos
 FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY score)
 WINDOW w AS (ORDER BY score DESC))
 WHERE next_pos IS NULL OR last_pos IS NULL OR pos <> next_pos OR neg <> next_neg
 UNION ALL SELECT NULL, 0e0, 0e0""",
    ),
    "ml10_folds": over_plays(
        """SELECT event_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY u, event_id) - 1) % 5 AS INTEGER) AS fold
 FROM (SELECT event_id, CAST(is_skip AS INTEGER) AS label, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 9, 8) AS BIGINT) AS u FROM plays)"""
    ),
    "ml16_cluster_profile_table": sql(ASSIGNED, "SELECT * FROM tab"),
    "ml20_cluster_insights": sql(
        ASSIGNED,
        f"""SELECT count(*) FILTER (WHERE avg_engagement_score > m) AS high_value_n, count(*) FILTER (WHERE avg_skip_rate > 0.5e0) AS at_risk_n,
 {r('sum(CASE WHEN avg_engagement_score < 30 THEN cluster_size ELSE 0 END) * 1e2 / sum(cluster_size)', 4)} AS casual_pct,
 {r('sum(CASE WHEN avg_skip_rate > 0.5e0 THEN cluster_size ELSE 0 END) * 1e2 / sum(cluster_size)', 4)} AS risk_pct
 FROM tab, (SELECT avg(avg_engagement_score) AS m FROM tab)""",
    ),
    "rt6_cluster_labels": sql(
        ASSIGNED,
        """SELECT cluster, CASE WHEN avg_skip_rate > 0.5e0 THEN 'Skip-Heavy Users (Low Satisfaction)'
 WHEN avg_engagement_score > 50 AND avg_play_count > 10 THEN 'Power Users (High Value)'
 WHEN avg_engagement_score > 30 THEN 'Engaged Users (Core Audience)' ELSE 'Casual Listeners (Growth Opportunity)' END AS profile_name FROM tab""",
    ),
}
