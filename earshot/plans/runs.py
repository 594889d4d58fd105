"""The steps from a raw CSV to features, models, segments and reports, each reading the step before."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.constants import RAW_COLUMNS
from earshot.learning import clusters, matrix, models
from earshot.operators import cleaning, entities, features, quality, sessions
from earshot.plans import activity, content, feature_table, kpis, platforms, retention, session_reports, skips
from earshot.session import configure
from earshot.sources import plays as readers
from earshot.sources import sinks
from earshot.sources.staging import stage


def with_row_key(df: DataFrame) -> DataFrame:
    """``event_id`` from the row's content: unique after duplicates are gone, the same on every run."""
    return df.withColumn("event_id", F.md5(F.to_json(F.struct(*df.columns))))


def by_date(df: DataFrame) -> DataFrame:
    """Spread for writing by date; adaptive execution splits a date that is too large for one task."""
    return df.hint("rebalance", "date")


def clean_run(spark: SparkSession, raw_csv: str, out: str, columns: Sequence[str] = RAW_COLUMNS) -> dict[str, str]:
    """Raw CSV to a cleaned table by date, with the audit log and summary beside it."""
    raw = readers.validate_schema(readers.read_plays(configure(spark), raw_csv, columns))
    cleaned = cleaning.clean(raw).withColumn("date", F.to_date("timestamp"))
    paths = {"plays": sinks.write_stage(by_date(with_row_key(cleaned)), f"{out}/plays", partition_by=["date"])}
    table = readers.read_stage(spark, paths["plays"])
    paths["audit"] = sinks.write_report(quality.audit_log(raw), f"{out}/audit_log")
    paths["summary"] = sinks.write_report(quality.dataset_summary(table), f"{out}/summary")
    return paths


def feature_run(spark: SparkSession, plays_path: str, out: str, gap: timedelta = sessions.GAP, leak_free: bool = False) -> dict[str, str]:
    """Cleaned table to the 82 feature columns, by date."""
    plays = readers.read_stage(configure(spark), plays_path).drop("date").withColumn("ms_played", F.col("ms_played").cast("bigint"))
    table = feature_table.build(plays, gap, leak_free)
    return {"features": sinks.write_stage(by_date(table), f"{out}/features", partition_by=["date"])}


def model_run(spark: SparkSession, features_path: str, out: str, settings: models.Settings = models.Settings(), ks: Sequence[int] = range(2, 9)) -> dict[str, str]:
    """Trains and compares the skip models, then segments the entities."""
    table = readers.read_stage(configure(spark), features_path)
    rows = matrix.split(matrix.skip_matrix(table)).persist()
    train, test = rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test").drop("is_test")
    fitted = {name: models.train(name, train, settings) for name in models.NAMES}
    results = {n: models.accuracy_and_auc(m, test) + models.cross_validate(n, train, settings) for n, m in fitted.items()}
    report = models.evaluation(spark, results)
    rows.unpersist()

    found = clusters.cluster(entities.cluster_profile(table), ks=ks)
    summary = clusters.cluster_profile_table(found.assigned, clusters.SCRIPT_MEANS)
    saved = models.save_models(fitted | {"scaler": found.scaler}, f"{out}/models")
    found.model.save(spark, f"{out}/models/centres")
    return saved | {
        "centres": f"{out}/models/centres",
        "model_summary": sinks.write_report(models.model_summary(spark, {n: r[:2] for n, r in results.items()}), f"{out}/model_summary"),
        "evaluation": sinks.write_json(report, f"{out}/evaluation"),
        "segments": sinks.write_stage(found.assigned, f"{out}/segments"),
        "segment_summary": sinks.write_report(summary, f"{out}/segment_summary"),
        "cluster_trials": sinks.write_report(found.trials, f"{out}/cluster_trials"),
    }


@dataclass(frozen=True)
class _Tables:
    """What the reports of one run read, each staged once."""

    plays: DataFrame
    sessions: DataFrame
    metrics: DataFrame
    stats: DataFrame

    @property
    def scored(self) -> DataFrame:
        return sessions.session_score(self.stats)


#: Report tables of a run, by the name of their folder.
REPORT_TABLES: dict[str, Callable[[_Tables], DataFrame]] = {
    "top_tracks": lambda t: content.top_tracks(t.plays),
    "top_artists": lambda t: content.top_artists(t.plays),
    "executive_summary": lambda t: kpis.executive_summary(t.plays, t.scored),
    "kpis": lambda t: kpis.eda_kpis(t.plays, t.stats),
    "platforms": lambda t: platforms.platform_engagement(t.plays),
    "artists": lambda t: content.artist_performance(t.plays),
    "artist_ranking": lambda t: content.artist_ranking(t.plays),
    "skip_drivers": lambda t: skips.skip_drivers(t.plays),
    "hourly": lambda t: activity.hourly(t.plays),
    "daily": lambda t: activity.daily(t.plays),
    "retention": lambda t: activity.retention_table(t.plays),
    "daily_retention": lambda t: retention.daily_retention(activity.daily_activity(t.plays)),
    "cohorts": lambda t: retention.cohort_retention(t.plays),
    "session_quality": lambda t: session_reports.session_quality_report(t.metrics),
    "session_platforms": lambda t: session_reports.session_platform_report(t.metrics),
    "session_journey": lambda t: session_reports.session_journey(t.sessions),
    "session_summary": lambda t: session_reports.session_summary(t.stats),
    "insights": lambda t: kpis.insights(
        t.plays, t.scored, retention.daily_retention(activity.daily_activity(t.plays)), retention.churn_trend(activity.daily_activity(t.plays))
    ),
}


def report_run(spark: SparkSession, plays_path: str, out: str, gap: timedelta = sessions.GAP) -> dict[str, str]:
    """Cleaned table to the wide plays, session tables and all report tables. A report reads tables that are written
    once; each is a job of its own."""
    plays = readers.read_stage(configure(spark), plays_path).drop("date").withColumn("ms_played", F.col("ms_played").cast("bigint"))
    wide = stage(features.wide_plays(plays), "wide_plays")
    with_ids = stage(sessions.assign_sessions(wide, gap), "sessions")
    tables = _Tables(wide, with_ids, stage(sessions.session_metrics(with_ids), "session_metrics"), stage(sessions.session_stats(with_ids), "session_stats"))
    paths = {
        "wide_plays": sinks.write_stage(by_date(wide.withColumn("date", F.to_date("timestamp"))), f"{out}/wide_plays", partition_by=["date"]),
        "session_events": sinks.write_stage(session_reports.session_events(with_ids), f"{out}/session_events"),
        "session_statistics": sinks.write_stage(tables.stats, f"{out}/session_statistics"),
    }
    return paths | {name: sinks.write_report(make(tables), f"{out}/{name}") for name, make in REPORT_TABLES.items()}


def register_views(spark: SparkSession, plays: DataFrame, gap: timedelta = sessions.GAP) -> None:
    """Views for SQL users: ``plays``, ``sessions_with_ids`` and ``session_metrics``."""
    wide = plays if "is_skip" in plays.columns else features.wide_plays(plays)
    with_ids = sessions.assign_sessions(wide, gap)
    for name, table in (("plays", wide), ("sessions_with_ids", with_ids), ("session_metrics", sessions.session_metrics(with_ids))):
        table.createOrReplaceTempView(name)
