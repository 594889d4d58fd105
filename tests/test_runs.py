"""The whole way from a raw CSV."""

import pytest
from pyspark.sql import functions as F

from earshot.constants import RAW_COLUMNS
from earshot.learning.kmeans import Centres
from earshot.learning.models import Settings, load_models
from earshot.plans import feature_table, runs
from earshot.plans.workspace import Workspace
from earshot.sources import plays as readers
from earshot.sources import sinks


@pytest.fixture(scope="module")
def out(spark, small_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    raw = sinks.write_stage(Workspace(spark, small_dir).dirty.select(*RAW_COLUMNS), f"{folder}/raw", "csv")
    paths = runs.clean_run(spark, raw, folder)
    paths |= runs.feature_run(spark, paths["plays"], folder)
    paths |= runs.report_run(spark, paths["plays"], f"{folder}/reports")
    settings = Settings(trees=3, tree_depth=3, iterations=10, rounds=2, round_depth=2, folds=2)
    return paths | runs.model_run(spark, paths["features"], folder, settings, ks=(2, 3))


def test_every_step_writes_its_tables(spark, out):
    cleaned, features = (spark.read.parquet(out[k]) for k in ("plays", "features"))
    assert features.count() == cleaned.count() > 900
    assert set(features.columns) == {"event_id", *feature_table.ALL} and len(feature_table.ALL) == 82
    assert cleaned.select("event_id").distinct().count() == cleaned.count()
    assert spark.read.json(out["evaluation"]).count() == 3
    assert spark.read.parquet(out["segments"]).where(F.col("cluster").isNull()).count() == 0
    audit = {(r.step, r.metric): int(r.value) for r in spark.read.csv(out["audit"], header=True).collect()}
    assert audit[("rows", "deduplicated")] == cleaned.count()


def test_reports_are_written_and_come_back(spark, out):
    for name in runs.REPORT_TABLES:
        table = spark.read.csv(out[name], header=True)
        assert table.count() > 0, name
    wide, stats = spark.read.parquet(out["wide_plays"]), spark.read.parquet(out["session_statistics"])
    assert wide.count() == spark.read.parquet(out["plays"]).count() == spark.read.parquet(out["session_events"]).count()
    summary = spark.read.csv(out["session_summary"], header=True, inferSchema=True).first()
    assert summary.sessions == stats.count()
    durations = sorted(r[0] for r in stats.select("session_duration_minutes").collect())
    middle = (durations[(len(durations) - 1) // 2] + durations[len(durations) // 2]) / 2
    assert summary.median_duration == pytest.approx(middle)


def test_saved_segments_come_back(spark, out):
    """The scaler and the centres read from disk put every entity where the run had put it."""
    segments = spark.read.parquet(out["segments"])
    scaler = load_models({"scaler": out["scaler"]})["scaler"]
    again = Centres.load(spark, out["centres"]).transform(scaler.transform(segments.drop("cluster")))
    pick = lambda df: sorted(map(tuple, df.select("track_uri", "cluster").collect()))
    assert pick(again) == pick(segments)
    assert spark.read.csv(out["model_summary"], header=True).count() == 3


def test_date_filters_prune_files(spark, out):
    one = spark.read.parquet(out["plays"]).where("date = '2024-01-05'")
    assert "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().executedPlan().toString()


def test_sql_users_find_their_views(spark, small_dir):
    ws = Workspace(spark, small_dir)
    runs.register_views(spark, ws.plays, ws.gap)
    top = spark.sql("SELECT artist_name, count(*) AS n FROM plays GROUP BY artist_name HAVING n >= 5 ORDER BY n DESC LIMIT 5")
    assert top.count() == 5
    assert spark.sql("SELECT sum(tracks_count) FROM session_metrics").first()[0] <= ws.plays.count()


def test_csv_stage_needs_a_schema(spark, out):
    with pytest.raises(ValueError):
        readers.read_stage(spark, out["audit"], "csv")


def test_csv_is_read_by_header(spark, tmp_path):
    from earshot.sources.plays import MissingColumns, read_plays

    (tmp_path / "a.csv").write_text('artist_name,ts,extra,spotify_track_uri\n"Bowie, D.","01-01-2024 10:00","x",t:1\n"""Heroes"", Pt. 1\nlive",,,t:2\n')
    rows = read_plays(spark, str(tmp_path), ("track_uri", "ts", "artist_name")).collect()
    assert sorted(tuple(r) for r in rows) == [("t:1", "01-01-2024 10:00", "Bowie, D."), ("t:2", None, '"Heroes", Pt. 1\nlive')]
    with pytest.raises(MissingColumns):
        runs.clean_run(spark, str(tmp_path), str(tmp_path / "out"))
