"""Every operator and report as a named query over one data set."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import constants as K
from earshot.functions import numbers, texts, times
from earshot.learning import clusters, kmeans, matrix, models, scores
from earshot.operators import cleaning, entities, features, joins, ordered, pivots, quality, sessions, trends
from earshot.plans import activity, content, kpis, platforms, retention, runs, segments, session_reports, skips
from earshot.plans import measures as m
from earshot.plans.workspace import Workspace
from earshot.sources import plays as readers
from earshot.sources import sinks
from earshot.sources.staging import stage, stage_path
from earshot.streaming import jobs
from earshot.streaming import plays as stream_plays

# Ten-minute gaps give many sessions on the test tables; per listener the log is sparser.
GAP = timedelta(minutes=10)
LISTENER_GAP = timedelta(hours=6)
Query = Callable[[Workspace], DataFrame]


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: numbers.round_half_up(F.col(c), digits) for c in cols})


# ---------------------------------------------------------------- sources and sinks

def _read_plays(ws: Workspace) -> DataFrame:
    path = sinks.write_stage(ws.dirty, stage_path(ws.spark, "raw"), "csv")
    return readers.read_plays(ws.spark, path, ("event_id", *K.RAW_COLUMNS))


def _read_stage(ws: Workspace) -> DataFrame:
    table = session_reports.session_events(ws.sessions, ["event_id"])
    path = sinks.write_stage(table, stage_path(ws.spark, "session_events"), "csv")
    return readers.read_stage(ws.spark, path, "csv", table.schema)


def _write_stage(ws: Workspace) -> DataFrame:
    table = ws.plays.select("event_id", "date", "platform", "ms_played", "is_skip", "listening_quality")
    path = sinks.write_stage(runs.by_date(table), stage_path(ws.spark, "by_date"), partition_by=["date"])
    return readers.read_stage(ws.spark, path)


def _write_report(ws: Workspace) -> DataFrame:
    report = content.top_tracks(ws.plays)
    path = sinks.write_report(report, stage_path(ws.spark, "top_tracks"))
    return readers.read_stage(ws.spark, path, "csv", report.schema)


def _odd_platforms(ws: Workspace) -> DataFrame:
    """Plays of which some have a rare platform or none."""
    kind = F.col("event_id") % 10
    return ws.plays.withColumn("platform", F.when(kind == 3, "cast to device").when(kind != 7, F.col("platform")))


def _read_quoted(ws: Workspace) -> DataFrame:
    """A raw file with quotes, commas and line breaks in names, columns in another order, and one more."""
    n = F.col("event_id") % 4
    name = F.when(n == 0, F.concat(F.lit('"'), "track_name", F.lit('", Pt. 1'))).when(n == 1, F.concat("track_name", F.lit("\nlive, twice")))
    odd = ws.dirty.withColumn("track_name", F.coalesce(name, "track_name")).withColumn("extra", F.lit('a,"b"')).withColumnRenamed("track_uri", "spotify_track_uri")
    shuffled = odd.select(*sorted(odd.columns, reverse=True))
    path = sinks.write_stage(shuffled, stage_path(ws.spark, "quoted"), "csv")
    return readers.read_plays(ws.spark, path, ("event_id", *K.RAW_COLUMNS))


def _validated_file(ws: Workspace) -> DataFrame:
    """Names as a file's header gives them."""
    path = sinks.write_stage(ws.dirty, stage_path(ws.spark, "raw"), "csv")
    return readers.validate_schema(ws.spark.read.options(**readers.csv_options()).csv(path)).select("event_id", "track_uri", "ts", "ms_played")


SOURCES: dict[str, Query] = {
    "src1_quoted_csv": _read_quoted,
    "src1_read_plays": _read_plays,
    "src2_read_stage": _read_stage,
    "src3_validate_schema": _validated_file,
    "snk1_write_stage": _write_stage,
    "snk2_write_report": _write_report,
    "snk5_audit_log": lambda ws: quality.audit_log(ws.dirty),
}

# ---------------------------------------------------------------- cleaning and quality

CLEANING: dict[str, Query] = {
    "cl1_drop_critical_nulls": lambda ws: cleaning.drop_critical_nulls(ws.dirty).select("event_id", "track_uri", "ts", "ms_played"),
    "cl2_fill_unknown": lambda ws: cleaning.fill_unknown(ws.dirty).select(
        "event_id", "track_name", "artist_name", "album_name", "reason_start", "reason_end", "platform"
    ),
    "cl3_to_bool": lambda ws: cleaning.to_bool(ws.dirty).select("event_id", "shuffle", "skipped"),
    "cl4_to_numeric": lambda ws: cleaning.to_numeric(ws.dirty).select("event_id", "ms_played"),
    "cl5_clean_text": lambda ws: cleaning.clean_text(ws.dirty).select("event_id", "platform", "track_name", "reason_start"),
    "cl6_parse_ts": lambda ws: cleaning.parse_ts(ws.dirty).select("event_id", "timestamp"),
    "cl7_cap": lambda ws: ws.dirty.transform(cleaning.to_numeric).transform(cleaning.cap).select("event_id", "ms_played"),
    "cl8_drop_negative": lambda ws: ws.dirty.transform(cleaning.to_numeric).transform(cleaning.drop_negative).select("event_id", "ms_played"),
    "cl9_dedupe": lambda ws: cleaning.dedupe(ws.dirty),
    "cl_clean": lambda ws: cleaning.clean(ws.dirty),
    "dq1_null_profile": lambda ws: quality.null_profile(ws.dirty, K.RAW_COLUMNS),
    "dq2_dup_count": lambda ws: quality.dup_count(ws.dirty),
    "dq3_near_dup_count": lambda ws: quality.near_dup_count(cleaning.parse_ts(ws.dirty)),
    "dq4_cardinality": lambda ws: quality.cardinality(ws.dirty, K.RAW_COLUMNS),
    "dq4_top_values": lambda ws: quality.top_values(ws.dirty, K.RAW_COLUMNS),
    "dq5_iqr_outliers": lambda ws: quality.iqr_outliers(cleaning.typed(ws.dirty)),
    "dq6_ts_range": lambda ws: quality.ts_range(ws.plays, "2024-01-20", "2024-01-05"),
    "dq7_domain_violations": lambda ws: quality.domain_violations(ws.plays),
    "dq8_rule_violations": lambda ws: quality.rule_violations(
        ws.dirty.transform(cleaning.typed).transform(cleaning.cap).transform(cleaning.drop_negative)
    ),
    "dq9_describe": lambda ws: quality.describe(ws.plays, ("ms_played", "hour_of_day", "day_of_week_num")),
    "dq9_describe_all": lambda ws: quality.describe_all(ws.plays, _DESCRIBED),
    "dq10_dataset_summary": lambda ws: quality.dataset_summary(cleaning.clean(ws.dirty)),
    "dq11_audit_trail": lambda ws: quality.audit_trail(ws.dirty),
    "dq12_feature_inventory": lambda ws: quality.feature_inventory(ws.features),
}

_DESCRIBED = (
    "platform", "track_name", "artist_name", "album_name", "reason_start", "reason_end", "shuffle", "skipped", "timestamp", "ms_played", "hour_of_day",
    "day_of_week_num",
)

# ---------------------------------------------------------------- row features

_CLEANED = ("event_id", "timestamp", "track_uri", "platform", "ms_played", "reason_start", "reason_end", "shuffle", "skipped")


def _calendar(ws: Workspace, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    df = features.add_calendar(ws.base.select(*_CLEANED))
    for step in steps:
        df = df.transform(step)
    return df


def _behaviour(ws: Workspace, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    df = features.add_max_length(ws.base.select(*_CLEANED))
    for step in steps:
        df = df.transform(step)
    return df


def _one_hot_sparse(ws: Workspace) -> DataFrame:
    """Size and set place of each play's vector over all tracks."""
    found = features.one_hot_sparse(ws.plays.select("event_id", "track_name"), "track_name", "v")
    values = vector_to_array("v")
    return found.select("event_id", F.size(values).cast("bigint").alias("n_tracks"), (F.array_position(values, 1.0) - 1).alias("track"))


def _one_hot(ws: Workspace) -> DataFrame:
    hot = ws.plays.transform(features.one_hot, "platform").transform(features.one_hot, "reason_start", None, 5)
    flagged = features.add_length_flags(hot)
    made = [c for c in flagged.columns if c not in ws.plays.columns]
    return flagged.select("event_id", *[F.col(f"`{c}`") for c in made])


FEATURES: dict[str, Query] = {
    "ft1_calendar": lambda ws: _calendar(ws).select(
        "event_id", "hour_of_day", "day_of_week", "day_of_week_num", "month", "year", "date", "week_of_year"
    ),
    "ft2_week_flags": lambda ws: _calendar(ws, features.add_week_flags).select("event_id", "is_weekend", "is_workday"),
    "ft3_time_of_day": lambda ws: _calendar(ws, features.add_time_of_day).select("event_id", "time_of_day"),
    "ft4_hour_flags": lambda ws: _calendar(ws, features.add_hour_flags).select(
        "event_id", "is_peak_hour", "is_morning_commute", "is_evening_commute", "is_late_night", "is_night"
    ),
    "ft5_season": lambda ws: _calendar(ws, features.add_season).select("event_id", "season"),
    "fb1_durations": lambda ws: features.add_durations(ws.base).select("event_id", "seconds_played", "minutes_played"),
    "fb2_max_length": lambda ws: _behaviour(ws).select("event_id", "estimated_track_length_ms", "track_length_seconds"),
    "fb3_percent_played": lambda ws: _behaviour(ws, features.add_percent_played).select("event_id", "percent_played"),
    "fb4_length_bin": lambda ws: _behaviour(ws, features.add_length_bin).select("event_id", "track_length_category"),
    "fb5_is_skip": lambda ws: _behaviour(ws, features.add_percent_played, features.add_is_skip).select("event_id", "is_skip"),
    "fb6_quality": lambda ws: _behaviour(ws, features.add_percent_played, features.add_quality).select("event_id", "listening_quality"),
    "fb7_engagement": lambda ws: _behaviour(
        ws, features.add_percent_played, features.add_is_skip, features.add_engagement
    ).select("event_id", "completion_score", "engagement_score"),
    "fc1_reason_flags": lambda ws: features.add_reason_flags(ws.base).select(
        "event_id", "is_autoplay", "is_manual_start", "is_manual_skip", "is_natural_end"
    ),
    "fc2_session_size_flags": lambda ws: features.add_session_size_flags(sessions.session_features(ws.sessions)).select(
        "event_id", "is_binge_session", "is_short_session"
    ),
    "fm1_crosses": lambda ws: features.add_crosses(ws.plays).select(
        "event_id", "hour_platform_interaction", "weekend_platform_interaction"
    ),
    "fm2_encode_sorted": lambda ws: features.encode_sorted(ws.plays, ["platform", "time_of_day", "listening_quality"]).select(
        "event_id", "platform_encoded", "time_of_day_encoded", "listening_quality_encoded"
    ),
    "fm3_nonlinear": lambda ws: _rounded(features.add_nonlinear(ws.plays), 6, "track_length_log").select(
        "event_id", "completion_squared", "track_length_log"
    ),
    "fm4_one_hot": _one_hot,
    "fm4_one_hot_sparse": _one_hot_sparse,
    "feature_table": lambda ws: _rounded(
        ws.features, 6, "rolling_5_skip_rate", "rolling_5_avg_completion", "track_length_log"
    ),
}

# ---------------------------------------------------------------- filters, joins, order, sets

FILTERS: dict[str, Query] = {
    "fl1_where": lambda ws: ws.plays.where(
        F.col("platform").isin("iOS", "mac") & F.col("hour_of_day").between(6, 11) & F.col("shuffle") & (F.col("ms_played") <= 59999)
    ).select("event_id", "platform", "hour_of_day", "ms_played"),
    "fl2_having": lambda ws: ws.plays.groupBy("track_uri", "artist_name").agg(m.plays().alias("plays")).where("plays >= 100"),
    "fl3_case_nullif_coalesce": lambda ws: ws.plays.select(
        "event_id",
        texts.relabel(F.col("platform"), {"iOS": "phone", "android": "phone"}, F.lit("other")).alias("device"),
        numbers.ratio(F.col("ms_played") * 1e0, F.col("hour_of_day")).alias("ms_per_hour"),
        F.coalesce(F.nullif(F.col("reason_start"), F.lit("trackdone")), F.lit("natural")).alias("start_label"),
    ),
    "fl4_select_available": lambda ws: features.select_available(
        ws.plays, ["hour_of_day", "is_weekend", "track_length_seconds", "not_there"], ["event_id"]
    ),
    "jn1_with_cohort": lambda ws: retention.with_cohort(ws.plays).select("event_id", "track_uri", "cohort_week"),
    "jn2_history_join": lambda ws: segments.with_history_stats(ws.plays).select(
        "event_id", "track_play_count", "historical_skip_rate", "track_length_seconds", "user_total_plays",
        "user_skip_tendency", "user_avg_completion", "preferred_platform",
    ),
    "jn3_attach": lambda ws: entities.attach_content(
        joins.attach(ws.plays, entities.entity_features(ws.plays), ["track_uri"], "entity_features")
    ).select(
        "event_id", "user_play_count", "user_skip_rate", "track_play_count", "track_skip_rate", "artist_play_count",
        "artist_unique_tracks",
    ),
    "jn4_with_columns": lambda ws: joins.with_columns(ws.plays, {
        "is_ios": (F.col("platform") == "iOS").cast("int"), "is_mac": (F.col("platform") == "mac").cast("int"),
    }).select("event_id", "is_ios", "is_mac"),
    "jn5_normalise_by_max": lambda ws: joins.normalise_by_max(
        ws.plays.groupBy("platform").agg(m.plays().alias("n"), F.sum("ms_played").alias("ms")), ["n", "ms"]
    ),
    "og1_ordered_lag": lambda ws: ordered.ordered_lag(ws.plays.select("event_id", "timestamp")).select(
        "event_id", "prev_timestamp", "gap_seconds"
    ),
    "og1_keyed_lag": lambda ws: ordered.ordered_lag(
        ws.plays.select("event_id", "user_id", "timestamp"), keys=["user_id"]
    ).select("event_id", "prev_timestamp", "gap_seconds"),
    "og2_with_previous": lambda ws: ordered.with_previous(ws.log).select(
        "event_id", "prev_platform", "platform_switch", "prev_track_skip", "prev_track_completion"
    ),
    "og3_running_sum": lambda ws: ws.log.running_sum(F.col("is_skip").cast("int")).select("event_id", "running"),
    "og3_keyed_running_sum": lambda ws: ordered.order_log(
        ws.plays.select("event_id", "user_id", "timestamp", "is_skip"), keys=["user_id"]
    ).running_sum(F.col("is_skip").cast("int")).select("event_id", "running"),
    "og4_rolling": lambda ws: _rounded(
        ordered.ordered_rolling(ws.log), 6, "rolling_5_skip_rate", "rolling_5_avg_completion"
    ).select("event_id", "rolling_5_skip_rate", "rolling_5_avg_completion"),
    "og4_rolling_leak_free": lambda ws: _rounded(
        ordered.ordered_rolling(ws.log, leak_free=True), 6, "rolling_5_skip_rate", "rolling_5_avg_completion"
    ).select("event_id", "rolling_5_skip_rate", "rolling_5_avg_completion"),
    "og5_position": lambda ws: sessions.position_from_index(sessions.assign_sessions(ws.log.rows, ws.gap)).select(
        "event_id", "session_id", "track_position_in_session"
    ),
    "og6_session_diversity": lambda ws: sessions.session_diversity(ws.sessions).select("event_id", "artist_diversity_in_session"),
    "sl1_order_by": lambda ws: ws.plays.groupBy(
        "platform", F.nullif(F.col("time_of_day"), F.lit("Night")).alias("part")
    ).agg(m.plays().alias("plays")).orderBy("platform", F.col("part").asc_nulls_last()),
    "sl2_top_k": lambda ws: ws.plays.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(1000).select(
        "event_id", "timestamp", "track_name"
    ),
    "sl3_order_log": lambda ws: ws.log.rows.select("event_id", "timestamp", "row_index"),
    "st1_union_all": lambda ws: ws.plays.groupBy(F.lit("platform").alias("dimension"), F.col("platform").alias("category"))
    .agg(m.plays().alias("plays"))
    .unionByName(
        ws.plays.groupBy(F.lit("time_of_day").alias("dimension"), F.col("time_of_day").alias("category")).agg(m.plays().alias("plays"))
    ),
}

# ---------------------------------------------------------------- scalar functions over every play

def scalars() -> dict[str, Column]:
    t = F.col("timestamp")
    day_time = F.date_format(t, K.TS_FORMAT)
    return {
        "sf1_round_half_up": numbers.round_half_up(F.col("percent_played"), 1),
        "sf2_round_half_even": numbers.round_half_even(F.col("percent_played"), 1),
        "sf3_power_log1p": numbers.round_half_up(F.pow("completion_score", F.lit(2.0)) + F.log1p("seconds_played"), 6),
        "sf4_minimum": numbers.cap(F.col("ms_played"), 30000),
        "sf5_abs": F.abs(F.col("ms_played") - 30000),
        "sf6_modulo": F.pmod(F.col("hour_of_day") + 2, F.lit(24)),
        "sf7_guarded_division": numbers.ratio(F.col("ms_played") * 1e0, F.col("hour_of_day")),
        "sf8_parse_timestamp": F.try_to_timestamp(
            F.when(F.col("event_id") % 7 == 0, "31-02-2024 10:00").otherwise(day_time), F.lit(K.TS_FORMAT)
        ),
        "sf9_format_timestamp": F.date_format(t, "yyyy-MM-dd HH:mm"),
        "sf10_hour": F.hour(t),
        "sf11_weekday_numbers": F.weekday(t) * 10 + F.dayofweek(t) - 1,
        "sf12_weekday_name": F.date_format(t, "EEEE"),
        "sf13_week_month_year": F.year(t) * 10000 + F.month(t) * 100 + F.weekofyear(t),
        "sf14_week_start": times.week_start(t),
        "sf15_minute_start": F.date_trunc("minute", t),
        "sf16_date": F.to_date(t),
        "sf17_gap_over_limit": t - F.date_trunc("hour", t) > F.expr("interval '30' minute"),
        "sf18_interval_minutes": times.minutes_between(F.date_trunc("day", t), t),
        "sf19_whole_days": times.whole_days_between(F.lit("2024-01-01 12:00:00").cast("timestamp"), t),
        "sf20_upper_lower_trim": F.concat(
            F.upper("platform"), F.lower("artist_name"), F.trim(F.concat(F.lit(" "), "album_name", F.lit(" ")))
        ),
        "sf21_replace_empty": texts.tidy(F.when(F.col("platform") == "iOS", "").otherwise(F.col("platform"))),
        "sf22_concatenate": F.concat_ws("_", "track_name", "artist_name"),
        "sf23_ellipsis": texts.ellipsis(F.col("track_name"), 8),
        "sf24_number_text": F.concat(
            texts.one_decimal_text(numbers.round_half_up(F.col("percent_played"), 1)), F.lit("% of "),
            texts.grouped_text(F.col("estimated_track_length_ms")),
        ),
        "sf25_casts": F.col("is_skip").cast("int")
        + F.coalesce(F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("event_id").cast("string")).try_cast("bigint"), F.lit(0)),
        "sf26_conditional": F.when(F.col("percent_played") >= 80, "High").when(F.col("percent_played") >= 50, "Medium").otherwise("Low"),
        "sf27_null_handling": F.coalesce(F.nullif(F.col("platform"), F.lit("android")), F.lit("none")),
        "sf28_membership": (F.col("platform").isin("iOS", "mac") & F.col("hour_of_day").between(6, 11)) | ~F.col("shuffle"),
        "sf29_right_closed_bins": numbers.right_closed_bin(
            F.col("ms_played"), ((20000, "short"), (40000, "middle"), (None, "long"))
        ),
        "sf30_equal_width_bins": numbers.equal_width_bin(F.col("percent_played"), F.lit(0.0), F.lit(100.0), 30),
    }


SCALAR_NAMES = (
    "sf1_round_half_up", "sf2_round_half_even", "sf3_power_log1p", "sf4_minimum", "sf5_abs", "sf6_modulo",
    "sf7_guarded_division", "sf8_parse_timestamp", "sf9_format_timestamp", "sf10_hour", "sf11_weekday_numbers",
    "sf12_weekday_name", "sf13_week_month_year", "sf14_week_start", "sf15_minute_start", "sf16_date",
    "sf17_gap_over_limit", "sf18_interval_minutes", "sf19_whole_days", "sf20_upper_lower_trim", "sf21_replace_empty",
    "sf22_concatenate", "sf23_ellipsis", "sf24_number_text", "sf25_casts", "sf26_conditional", "sf27_null_handling",
    "sf28_membership", "sf29_right_closed_bins", "sf30_equal_width_bins",
)


def _scalar(name: str) -> Query:
    return lambda ws: ws.plays.select("event_id", scalars()[name].alias("result"))


# ---------------------------------------------------------------- reports

REPORTS: dict[str, Query] = {
    "ag1_top_tracks": lambda ws: content.top_tracks(ws.plays),
    "ag1_listening_time_leaders": lambda ws: content.listening_time_leaders(ws.plays),
    "ag2_top_artists": lambda ws: content.top_artists(ws.plays),
    "ag2_artist_leaders": lambda ws: content.artist_leaders(ws.plays),
    "ag2_artist_leaders_by_hours": lambda ws: content.artist_leaders(ws.plays, "total_hours", 10),
    "ag3_platform_report": lambda ws: platforms.platform_report(ws.plays),
    "ag3_platform_table": lambda ws: platforms.platform_table(ws.plays),
    "ag4_platform_by_time": lambda ws: platforms.platform_by_time(ws.plays),
    "ag5_hourly": lambda ws: activity.hourly(ws.plays),
    "ag6_weekday": lambda ws: activity.weekday(ws.plays),
    "ag7_monthly": lambda ws: activity.monthly(ws.plays),
    "ag7_by_time": lambda ws: activity.by_time(ws.plays),
    "ag8_skip_by_dimension": lambda ws: skips.skip_by_dimension(ws.plays),
    "ag8_skip_drivers": lambda ws: skips.skip_drivers(ws.plays),
    "ag9_most_skipped_tracks": lambda ws: content.most_skipped_tracks(ws.plays),
    "ag10_most_skipped_artists": lambda ws: content.skip_extremes(ws.plays),
    "ag10_least_skipped_artists": lambda ws: content.skip_extremes(ws.plays, ascending=True),
    "ag11_daily": lambda ws: activity.daily(ws.plays),
    "ag12_weekly": lambda ws: activity.weekly(ws.plays),
    "ag12_weekly_from_daily": lambda ws: activity.weekly_from_daily(ws.plays),
    "ag13_quality_distribution": lambda ws: activity.quality_distribution(ws.plays),
    "ag14_skip_summary": lambda ws: skips.skip_summary(ws.plays),
    "ag15_skip_by_reason_end": lambda ws: skips.skip_by_reason_end(ws.plays),
    "ag16_journey_matrix": lambda ws: skips.journey_matrix(ws.plays),
    "ag17_discovery": lambda ws: skips.discovery(ws.plays),
    "ag18_length_vs_skip": lambda ws: skips.length_vs_skip(ws.plays),
    "ag19_entity_stats": lambda ws: entities.entity_stats(ws.plays),
    "ag20_content_stats": lambda ws: entities.content_stats(ws.plays),
    "ag21_popularity": lambda ws: entities.attach_content(ws.plays).select("event_id", "track_popularity", "artist_popularity"),
    "ag22_cluster_profile": lambda ws: entities.cluster_profile(ws.sessions),
    "ag23_entity_profile": lambda ws: entities.entity_profile(ws.plays),
    "ag24_mode": lambda ws: joins.with_modes(
        ws.plays.select("artist_name").distinct(), ws.plays, ["artist_name"], {c: c for c in ("platform", "reason_start", "hour_of_day")}
    ),
    "ag25_rollup_report": lambda ws: platforms.rollup_report(ws.plays),
    "ag26_cube_report": lambda ws: platforms.cube_report(ws.plays),
    "ag27_kpi_table": lambda ws: kpis.kpi_table(ws.plays),
    "ag28_eda_kpis": lambda ws: kpis.eda_kpis(ws.plays, ws.stats),
    "ag29_executive_summary": lambda ws: kpis.executive_summary(ws.plays, ws.scored),
    "ag30_overview": lambda ws: activity.overview(ws.plays),
    "ag31_raw_skip_by_platform": lambda ws: skips.raw_skip_by(ws.plays, "platform"),
    "ag31_raw_skip_by_hour": lambda ws: skips.raw_skip_by(ws.plays, "hour_of_day"),
    "ag32_peak_report": lambda ws: activity.peak_report(ws.plays),
    "ag33_platform_engagement": lambda ws: _rounded(platforms.platform_engagement(ws.plays), 6, "engagement_score"),
    "ag34_artist_performance": lambda ws: _rounded(content.artist_performance(ws.plays), 6, "engagement_score"),
    "ag35_skip_correlations": lambda ws: skips.skip_correlations(ws.plays),
    "ag36_dispersion_daily": lambda ws: trends.dispersion(activity.daily_activity(ws.plays), "daily_plays"),
    "ag36_dispersion_weekly": lambda ws: trends.dispersion(activity.weekly(ws.plays), "weekly_plays"),
    "ag37_histogram_duration": lambda ws: session_reports.histogram(ws.stats, "session_duration_minutes", 50),
    "ag37_histogram_tracks": lambda ws: session_reports.histogram(ws.stats, "tracks_count", 30),
    "ag37_histogram_skip_rate": lambda ws: session_reports.histogram(ws.stats, "skip_rate", 30),
    "ag38_switch_rate": lambda ws: platforms.switch_rate(ws.log),
    "pv1_weekday_hour": lambda ws: pivots.pivot_counts(ws.plays, "day_of_week_num", "hour_of_day", range(24), "h"),
    "pv2_platform_time_share": lambda ws: pivots.pivot_share(ws.plays, "platform", "time_of_day", K.DAY_PARTS),
    "pv3_hour_platform": lambda ws: pivots.cross_counts(_odd_platforms(ws), "hour_of_day", "platform"),
    "pv4_time_platform_share": lambda ws: pivots.cross_shares(_odd_platforms(ws), "time_of_day", "platform"),
    "wn1_trailing_avg": lambda ws: activity.rolling_report(ws.plays),
    "wn2_centred_avg": lambda ws: activity.centred_report(ws.plays),
    "wn2_retention_table": lambda ws: _rounded(activity.retention_table(ws.plays), 6, "daily_minutes"),
    "wn3_pct_change": lambda ws: trends.pct_change(
        activity.daily(ws.plays).select("date", "daily_plays"), "daily_plays", 1, "dod_plays_change", previous="prev_day_plays"
    ),
    "wn4_artist_ranking": lambda ws: content.artist_ranking(ws.plays),
    "wn5_share": lambda ws: _rounded(joins.share_of_total(
        ws.plays.groupBy("artist_name", "platform").agg(m.plays().alias("plays")), "plays", "pct", ["artist_name"]
    ), 4, "pct"),
    "wn6_first_in_group": lambda ws: trends.first_in_group(
        ws.plays.groupBy("platform", "date").agg(F.countDistinct("track_uri").alias("tracks")), "tracks", ["platform"], "date", "base"
    ),
    "wn7_delta": lambda ws: trends.delta(
        ws.plays.groupBy("hour_of_day").agg(m.skip_pct().alias("rate")), "rate", "hour_of_day", "change"
    ),
}

# ---------------------------------------------------------------- sessions, retention, segments

SESSIONS: dict[str, Query] = {
    "se1_sessionize": lambda ws: sessions.sessionize(ws.plays.select("event_id", "timestamp"), ws.gap).select(
        "event_id", "prev_timestamp", "time_since_last", "is_session_start", "session_id"
    ),
    "se1_assign_sessions": lambda ws: ws.sessions.select("event_id", "session_id", "is_session_start"),
    "se1_keyed_sessions": lambda ws: sessions.assign_sessions(
        ws.plays.select("event_id", "user_id", "timestamp"), LISTENER_GAP, ["user_id"]
    ).select("event_id", "user_id", "is_session_start", "session_id"),
    "se2_session_report": lambda ws: sessions.session_report(ws.sessions),
    "se3_session_metrics": lambda ws: ws.metrics,
    "se4_session_features": lambda ws: sessions.session_features(ws.sessions).select(
        "event_id", "session_id", "session_track_count", "session_skip_rate", "session_avg_engagement",
        "session_duration_minutes", "session_quality",
    ),
    "se5_session_score": lambda ws: _rounded(ws.scored, 6, "session_quality_score").select(
        "session_id", "primary_platform", "session_quality_score", "quality_category"
    ),
    "se5_score_shares": lambda ws: session_reports.score_shares(ws.scored),
    "se5_score_by_platform": lambda ws: session_reports.score_by_platform(ws.scored),
    "se6_session_quality_report": lambda ws: session_reports.session_quality_report(ws.metrics),
    "se7_session_platform_report": lambda ws: session_reports.session_platform_report(ws.metrics),
    "se8_session_time_report": lambda ws: session_reports.session_time_report(ws.metrics),
    "se9_session_journey": lambda ws: session_reports.session_journey(ws.sessions),
    "se10_session_segments": lambda ws: session_reports.session_segments(ws.metrics),
    "se11_daily_sessions": lambda ws: session_reports.daily_sessions(ws.metrics),
    "se11_daily_sessions_per_platform": lambda ws: session_reports.daily_sessions(ws.metrics, per_platform=True),
    "se12_session_summary": lambda ws: session_reports.session_summary(ws.stats),
    "se12_platform_sessions": lambda ws: activity.count_by(ws.stats, "primary_platform"),
    "rt1_cohort_retention": lambda ws: retention.cohort_retention(ws.plays),
    "rt1_cohort_retention_by_user": lambda ws: retention.cohort_retention(ws.plays, "user_id"),
    "rt2_daily_retention": lambda ws: retention.daily_retention(activity.daily_activity(ws.plays)),
    "rt3_churn_trend": lambda ws: retention.churn_trend(activity.daily_activity(ws.plays)),
    "rt4_entity_segment": lambda ws: entities.entity_segment(entities.entity_stats(ws.plays)).select(
        "track_uri", "play_count", "skip_rate", "avg_engagement", "user_segment"
    ),
    "rt5_skip_risk": lambda ws: segments.skip_risk(ws.plays),
    "rt7_insights": lambda ws: kpis.insights(
        ws.plays, ws.scored, retention.daily_retention(activity.daily_activity(ws.plays)),
        retention.churn_trend(activity.daily_activity(ws.plays)),
    ),
}


# ---------------------------------------------------------------- models and segments

# Small settings, so that a run over all queries stays short; the library's defaults are larger.
SETTINGS = models.Settings(trees=20, tree_depth=6, iterations=100, rounds=10, round_depth=4, folds=3)


def _model(ws: Workspace, name: str):
    return ws.keep(f"model {name}", lambda: models.train(name, ws.train, SETTINGS))


def _trained(name: str) -> Query:
    return lambda ws: models.score(_model(ws, name), ws.test).select("event_id", "label", "prediction", "score")


def _tested(ws: Workspace, name: str) -> tuple[float, float]:
    return ws.keep(f"test {name}", lambda: models.accuracy_and_auc(_model(ws, name), ws.test))


def _summarised(ws: Workspace) -> DataFrame:
    return models.model_summary(ws.spark, {n: _tested(ws, n) for n in models.NAMES})


def _evaluated(ws: Workspace) -> DataFrame:
    return models.evaluation(ws.spark, {n: _tested(ws, n) + _validated(ws, n) for n in models.NAMES})


def _validated(ws: Workspace, name: str) -> tuple[float, float]:
    return ws.keep(f"cv {name}", lambda: models.cross_validate(name, ws.train, SETTINGS))


def _cross_validated(ws: Workspace) -> DataFrame:
    mean, spread = _validated(ws, models.LOGISTIC)
    return ws.spark.createDataFrame([(models.LOGISTIC, mean, spread)], "model string, cv_auc double, cv_std double")


def _reloaded(ws: Workspace) -> DataFrame:
    paths = models.save_models({models.LOGISTIC: _model(ws, models.LOGISTIC)}, stage_path(ws.spark, "models"))
    loaded = models.load_models(paths)[models.LOGISTIC]
    return models.score(loaded, ws.test).select("event_id", "label", "prediction", "score")


def _saved_agree(ws: Workspace) -> DataFrame:
    """Rows, and rows that get the same answer, before and after a classifier and the segments' scaler and centres were
    saved and loaded."""
    found, folder = _clustering(ws), stage_path(ws.spark, "saved")
    paths = models.save_models({models.LOGISTIC: _model(ws, models.LOGISTIC), "scaler": found.scaler}, folder)
    found.model.save(ws.spark, f"{folder}/centres")
    loaded = models.load_models(paths)
    scored = (models.score(m, ws.test).select("event_id", "prediction", "score") for m in (_model(ws, models.LOGISTIC), loaded[models.LOGISTIC]))
    again = kmeans.Centres.load(ws.spark, f"{folder}/centres").transform(loaded["scaler"].transform(found.assigned.drop("cluster")))
    pairs = {"classifier": (*scored, "event_id"), "segments": (found.assigned.select("track_uri", "cluster"), again.select("track_uri", "cluster"), "track_uri")}
    counted = []
    for part, (a, b, key) in pairs.items():
        values = [c for c in a.columns if c != key]
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in values])
        both = a.join(b.withColumnsRenamed({c: f"_{c}" for c in values}), key, "left")
        counted.append(both.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.count_if(same).alias("n_same")))
    return counted[0].unionByName(counted[1])


def _by_completion(ws: Workspace) -> DataFrame:
    """A score that needs no training: how much of the track was left unplayed."""
    left = 1 - F.col("completion_score")
    return ws.plays.select(
        "event_id", F.col("is_skip").cast("int").alias("label"), left.alias("score"),
        F.when(left > 0.5, 1).otherwise(0).alias("prediction"),
    )


def _assigned(ws: Workspace) -> DataFrame:
    """Entity profiles with a given assignment: clusters by track number."""
    number = F.substring_index("track_uri", ":", -1).cast("bigint")
    return entities.entity_profile(ws.plays).withColumn("cluster", (number % 4).cast("int"))


def _clustering(ws: Workspace) -> clusters.Clustering:
    return ws.keep("clustering", lambda: clusters.cluster(entities.cluster_profile(ws.sessions), ks=(2, 3, 4), seeds=(42, 43)))


def _written_json(ws: Workspace) -> DataFrame:
    path = sinks.write_json(scores.binary_metrics(_by_completion(ws)), stage_path(ws.spark, "evaluation"))
    return ws.spark.read.schema("accuracy double, auc double").json(path)


def _explained(ws: Workspace) -> DataFrame:
    """Explained variance of both components and the projected cluster centres."""
    found = _clustering(ws)
    _, model = clusters.pca2(found.scaled)
    first, second = (float(v) for v in model.explainedVariance)
    return clusters.centroids(ws.spark, found, model).withColumns({"explained_1": F.lit(first), "explained_2": F.lit(second)})


def _cluster_summary(ws: Workspace) -> DataFrame:
    found = _clustering(ws)
    return clusters.clustering_summary(ws.spark, found, clusters.pca2(found.scaled)[1])


def _final_summary(ws: Workspace) -> DataFrame:
    days = activity.daily_activity(ws.plays)
    return kpis.final_summary(
        models.best_model(_summarised(ws)), _cluster_summary(ws), retention.daily_retention(days), retention.churn_trend(days)
    )


LEARNING: dict[str, Query] = {
    "ml1_skip_matrix": lambda ws: _rounded(matrix.skip_matrix(ws.features), 6, "rolling_5_skip_rate"),
    "ml2_skip_matrix_basic": lambda ws: matrix.skip_matrix_basic(ws.plays),
    "ml3_split": lambda ws: matrix.split(
        ws.plays.select("event_id", F.col("is_skip").cast("int").alias("label"))
    ),
    "ml4_feature_stats": lambda ws: matrix.feature_stats(matrix.skip_matrix_basic(ws.plays)),
    "ml5_random_forest": _trained(models.RANDOM_FOREST),
    "ml6_logistic_regression": _trained(models.LOGISTIC),
    "ml7_gradient_boosting": _trained(models.BOOSTING),
    "ml8_class_weights": lambda ws: matrix.class_weights(ws.plays.select(F.col("is_skip").cast("int").alias("label"))),
    "ml9_binary_metrics": lambda ws: scores.binary_metrics(_by_completion(ws)),
    "ml10_cross_validate": _cross_validated,
    "ml11_best_model": lambda ws: models.best_model(_summarised(ws)),
    "ml12_importances": lambda ws: models.importances(
        ws.spark, _model(ws, models.RANDOM_FOREST), matrix.feature_names(ws.train)
    ),
    "ml13_confusion": lambda ws: scores.confusion(_by_completion(ws)),
    "ml13_report": lambda ws: scores.report(_by_completion(ws)),
    "ml14_roc": lambda ws: scores.roc(_by_completion(ws)),
    "ml14_roc_corners": lambda ws: scores.roc_corners(_by_completion(ws)),
    "ml10_folds": lambda ws: matrix.add_folds(ws.plays.select("event_id", F.col("is_skip").cast("int").alias("label"))),
    "ml15_cluster_trials": lambda ws: _clustering(ws).trials,
    "ml15_cluster": lambda ws: _clustering(ws).assigned.select("track_uri", "cluster"),
    "ml16_cluster_profile_table": lambda ws: clusters.cluster_profile_table(_assigned(ws)),
    "ml16_found_clusters": lambda ws: clusters.cluster_profile_table(_clustering(ws).assigned, clusters.SCRIPT_MEANS),
    "ml17_pca": lambda ws: clusters.pca2(_clustering(ws).scaled)[0],
    "ml17_centroids": _explained,
    "ml18_score": lambda ws: models.score(_model(ws, models.BOOSTING), matrix.skip_matrix(ws.features)).select(
        "event_id", "prediction", "score"
    ),
    "ml19_evaluation": _evaluated,
    "ml19_model_summary": _summarised,
    "ml19_clustering_summary": _cluster_summary,
    "ml19_final_summary": _final_summary,
    "ml20_cluster_insights": lambda ws: clusters.cluster_insights(clusters.cluster_profile_table(_assigned(ws))),
    "rt6_cluster_labels": lambda ws: clusters.cluster_labels(clusters.cluster_profile_table(_assigned(ws))).select(
        "cluster", "profile_name"
    ),
    "snk3_write_json": _written_json,
    "snk4_save_models": _reloaded,
    "snk4_saved_agree": _saved_agree,
}

# ---------------------------------------------------------------- streams


def _stream(ws: Workspace, table: DataFrame, name: str) -> DataFrame:
    folder = sinks.write_stage(table, stage_path(ws.spark, name))
    return jobs.read_stream(ws.spark, folder, table)


def _drained(ws: Workspace, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """All groups of the plays as a stream that ends."""
    plays = ws.plays.select(*_STREAMED)
    folder = sinks.write_stage(plays, stage_path(ws.spark, "stream_in"))
    return jobs.run_to_table(job(jobs.read_stream(ws.spark, folder, plays)), name, lambda: jobs.close_stream(folder, plays))


_STREAMED = ("event_id", "user_id", "timestamp", "ms_played", "is_skip")
_LISTENED = ("event_id", "user_id", "timestamp", "platform", "is_skip", "percent_played", "engagement_score")
_SHARES = (
    "prev_track_completion", "rolling_5_skip_rate", "rolling_5_avg_completion", "session_skip_rate", "session_avg_engagement", "session_duration_minutes",
)


def _listened(ws: Workspace, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    plays = ws.plays.select(*_LISTENED)
    folder = sinks.write_stage(plays, stage_path(ws.spark, "stream_in"))
    return jobs.run_to_table(job(jobs.read_stream(ws.spark, folder, plays)), name, lambda: jobs.close_stream(folder, plays))


def _play_model(ws: Workspace):
    """Trained on the batch's features, for the stream's."""
    def trained():
        plays = ws.plays.select(*_LISTENED)
        featured = stream_plays.keyed_features(plays, LISTENER_GAP).join(plays.select("event_id", "is_skip"), "event_id")
        return models.train(models.LOGISTIC, stage(stream_plays.play_matrix(featured), "play_matrix"), SETTINGS)

    return ws.keep("play model", trained)

STREAMS: dict[str, Query] = {
    "xs1_stream_sessions": lambda ws: _rounded(
        _drained(ws, lambda plays: jobs.stream_sessions(plays, gap="6 hours"), "stream_sessions"), 6, "minutes", "skip_rate"
    ),
    "xs2_stream_kpis": lambda ws: _rounded(_drained(ws, jobs.stream_kpis, "stream_kpis"), 6, "skip_rate", "hours"),
    "xs2_stream_kpis_sliding": lambda ws: _rounded(
        _drained(ws, lambda plays: jobs.stream_kpis(plays, "1 hour", "30 minutes"), "stream_kpis"), 6, "skip_rate", "hours"
    ),
    "xs3_stream_dedupe": lambda ws: jobs.run_to_table(
        jobs.stream_dedupe(_stream(ws, cleaning.parse_ts(ws.dirty).select("event_id", "timestamp", "track_uri"), "stream_in")),
        "stream_dedupe",
    ),
    "xs4_stream_features": lambda ws: _rounded(
        _listened(ws, lambda plays: stream_plays.stream_features(plays, LISTENER_GAP), "stream_features"), 6, *_SHARES
    ),
    "xs4_stream_scores": lambda ws: _listened(ws, lambda plays: stream_plays.stream_scores(plays, _play_model(ws), LISTENER_GAP), "stream_scores"),
    "xs4_stream_score": lambda ws: jobs.run_to_table(
        jobs.stream_score(
            _stream(ws, matrix.skip_matrix(ws.features), "stream_in"), _model(ws, models.LOGISTIC)
        ).select("event_id", "prediction", "score"),
        "stream_score",
    ),
}


def all_queries() -> dict[str, Query]:
    found = SOURCES | CLEANING | FEATURES | FILTERS | REPORTS | SESSIONS | LEARNING | STREAMS
    return found | {name: _scalar(name) for name in SCALAR_NAMES}


def as_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Workspace(spark, sf_dir, GAP))

    return {name: bind(query) for name, query in all_queries().items()}


