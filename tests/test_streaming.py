import pytest
from pyspark.sql import functions as F

from earshot.operators import sessions
from earshot.plans.workspace import Workspace
from earshot.sources.sinks import write_stage
from earshot.sources.staging import stage_path
from earshot.learning import models
from earshot.streaming import jobs
from earshot.streaming import plays as stream_plays


@pytest.fixture(scope="module")
def plays(spark, small_dir):
    return Workspace(spark, small_dir).plays.select("event_id", "user_id", "timestamp", "ms_played", "is_skip")


def as_stream(spark, df, files=1, per_trigger=None):
    folder = write_stage(df.repartitionByRange(files, "timestamp", "event_id"), stage_path(spark, "stream_in"))
    return jobs.read_stream(spark, folder, df, per_trigger)


def test_stream_sessions_equal_batch_but_for_open_ones(spark, plays):
    from datetime import timedelta

    batch = sessions.assign_sessions(plays, timedelta(hours=6), ["user_id"]).groupBy("user_id", "session_id").agg(
        F.min("timestamp").alias("s"), F.max("timestamp").alias("e"), F.count("*").alias("n")
    )
    last = plays.agg(F.max("timestamp")).first()[0]
    closed = batch.where(F.col("e") + F.expr("interval '6' hour") <= F.lit(last) - F.expr("interval '1' hour"))
    streamed = jobs.run_to_table(jobs.stream_sessions(as_stream(spark, plays), gap="6 hours"), "t_sessions")
    pick = lambda d, *c: sorted(tuple(r) for r in d.select(*c).collect())
    assert pick(streamed, "user_id", "session_start", "session_end", "tracks") == pick(closed, "user_id", "s", "e", "n")


def test_repeated_rows_in_later_files_are_dropped(spark, plays):
    twice = plays.unionByName(plays.where("event_id % 5 = 0"))
    out = jobs.run_to_table(jobs.stream_dedupe(as_stream(spark, twice, 4, 1), lateness="40 days"), "t_dedupe")
    assert out.count() == plays.count()


def test_kpi_windows_equal_batch(spark, plays):
    out = jobs.run_to_table(jobs.stream_kpis(as_stream(spark, plays)), "t_kpis")
    batch = plays.groupBy(F.window("timestamp", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    counts = {r.w.start: r.n for r in batch.collect()}
    rows = out.collect()
    assert rows and all(counts[r.window_start] == r.plays for r in rows)
    assert len(counts) - len(rows) <= 3


def test_ended_streams_equal_batch(spark, plays):
    folder = write_stage(plays, stage_path(spark, "stream_in"))
    stream = jobs.stream_kpis(jobs.read_stream(spark, folder, plays))
    out = jobs.run_to_table(stream, "t_closed", lambda: jobs.close_stream(folder, plays))
    batch = plays.groupBy(F.window("timestamp", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    assert {r.window_start: r.plays for r in out.collect()} == {r.w.start: r.n for r in batch.collect()}


@pytest.fixture(scope="module")
def listened(spark, small_dir):
    return Workspace(spark, small_dir).plays.select("event_id", "user_id", "timestamp", "platform", "is_skip", "percent_played", "engagement_score")


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*stream_plays.FEATURES).collect())


def test_streamed_play_features_equal_batch(spark, listened):
    """Plays come in three batches, out of order within the lateness; state carries sessions and rings across them."""
    folder = stage_path(spark, "stream_in")
    days = [F.dayofmonth("timestamp") < 11, F.dayofmonth("timestamp").between(11, 20), F.dayofmonth("timestamp") > 20]
    for part in days:  # files are read in the order in which they were written
        listened.where(part).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(folder)
    stream = stream_plays.stream_features(jobs.read_stream(spark, folder, listened, 1), lateness="2 days")
    out = jobs.run_to_table(stream, "t_features", lambda: jobs.close_stream(folder, listened))
    assert rounded(out) == rounded(stream_plays.keyed_features(listened)) and out.count() == listened.count()


def test_sessions_wait_for_the_watermark_and_late_plays_are_dropped(spark, listened):
    start = listened.agg(F.min("timestamp").cast("timestamp")).first()[0]
    play = lambda i, minutes: (i, 1, minutes, "iOS", i % 2 == 0, 50.0, 0.5)
    make = lambda rows: spark.createDataFrame(rows, "event_id bigint, user_id bigint, m int, platform string, is_skip boolean, percent_played double, engagement_score double").select(
        "event_id", "user_id", (F.lit(start).cast("timestamp") + F.make_interval(mins="m")).alias("timestamp"), "platform", "is_skip", "percent_played", "engagement_score"
    )
    folder = write_stage(make([play(1, 0), play(2, 60)]).coalesce(1), stage_path(spark, "stream_in"))
    like = make([play(1, 0)])
    steps = [[play(3, 900)], [play(4, 10)], [play(5, 3000)]]  # 4 is long over when it comes

    def more():
        for i, rows in enumerate(steps):
            make(rows).coalesce(1).write.mode("append").parquet(folder)
            query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start(path)
            query.awaitTermination()

    stream, path = stream_plays.stream_features(jobs.read_stream(spark, folder, like), lateness="10 minutes"), stage_path(spark, "t_late")
    more()
    found = {r.event_id: r for r in spark.read.schema(stream.schema).parquet(path).collect()}
    assert set(found) == {1, 2, 3}
    assert found[2].session_track_count == 2 and found[3].track_position_in_session == 1 and found[3].prev_track_skip is True


def test_streamed_scores_equal_batch_scores(spark, listened):
    featured = stream_plays.keyed_features(listened).join(listened.select("event_id", "is_skip"), "event_id")
    rows = stream_plays.play_matrix(featured).cache()
    model = models.train(models.LOGISTIC, rows, models.Settings(iterations=20))
    folder = write_stage(listened, stage_path(spark, "stream_in"))
    stream = stream_plays.stream_scores(jobs.read_stream(spark, folder, listened), model)
    out = jobs.run_to_table(stream, "t_scores", lambda: jobs.close_stream(folder, listened))
    pick = lambda df: sorted((r.event_id, r.prediction, round(r.score, 9)) for r in df.collect())
    assert pick(out) == pick(models.score(model, rows).select("event_id", "prediction", "score"))
