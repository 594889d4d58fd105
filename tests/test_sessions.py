import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.operators import features, sessions
from earshot.plans import session_reports


def ids(df):
    return [r.session_id for r in df.orderBy("timestamp", "event_id").collect()]


def test_gap_of_exactly_thirty_minutes_stays(plays_of):
    df = plays_of([(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 10:30:00"), (3, 1, "2024-01-01 11:00:01"), (4, 1, "2024-01-03 00:00:00")])
    out = sessions.assign_sessions(df)
    assert ids(out) == [1, 1, 2, 3]
    assert [r.is_session_start for r in out.orderBy("event_id").collect()] == [True, False, True, True]


def test_equal_times_start_one_session(plays_of):
    df = plays_of([(2, 1, "2024-01-01 10:00:00"), (1, 1, "2024-01-01 10:00:00")])
    out = sessions.assign_sessions(df).orderBy("event_id").collect()
    assert [(r.session_id, r.is_session_start) for r in out] == [(1, True), (1, False)]


@pytest.mark.parametrize("keys", [(), ("user_id",)])
def test_random_logs_equal_plain_windows(plays_of, monkeypatch, keys):
    """With few buckets per span."""
    monkeypatch.setattr(sessions, "SPAN_BUCKETS", 3)
    random.seed(3)
    at = 0
    rows = []
    for i in range(400):
        at += random.choice([0, 1, 59, 600, 601, 1200, 5000])
        rows.append((i, random.choice([1, 1, 2, 3]), at))
    df = plays_of([(i, u, "1970-01-01 00:00:00") for i, u, _ in rows])
    times = df.sparkSession.createDataFrame([(i, t) for i, _, t in rows], "event_id bigint, s bigint")
    df = df.drop("timestamp").join(times, "event_id").withColumn("timestamp", F.timestamp_seconds("s"))
    gap = timedelta(minutes=10)
    w = Window.partitionBy(*keys).orderBy("timestamp", "event_id")
    lagged = df.withColumn("prev", F.lag("s").over(w))
    start = F.when(F.col("prev").isNull() | (F.col("s") - F.col("prev") > 600), 1).otherwise(0)
    plain = lagged.withColumn("start", start).withColumn("id", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    expected = sorted((r.event_id, r.id, bool(r.start)) for r in plain.collect())
    found = sessions.assign_sessions(df, gap, keys)
    assert sorted((r.event_id, r.session_id, r.is_session_start) for r in found.collect()) == expected


def test_zero_length_session_has_no_efficiency(plays_of):
    df = plays_of([(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 10:00:00")]).transform(features.wide_plays)
    row = sessions.session_metrics(sessions.assign_sessions(df)).first()
    assert row.listening_efficiency is None and row.session_duration_minutes == 0.0


def test_position_from_index_equals_row_number(plays_of):
    from earshot.operators.ordered import order_log

    random.seed(5)
    df = plays_of([(i, 1, f"2024-01-01 {random.randint(0, 23):02d}:{random.randint(0, 59):02d}:00") for i in range(200)])
    log = order_log(df)
    a = sessions.position_from_index(sessions.assign_sessions(log.rows, timedelta(minutes=5)))
    b = sessions.position(sessions.assign_sessions(df, timedelta(minutes=5)), first=1000)
    pick = lambda d: sorted((r.event_id, r.track_position_in_session) for r in d.collect())
    assert pick(a) == pick(b)


def test_known_session_counts(spark, middle_dir):
    from earshot.plans.workspace import Workspace

    base = Workspace(spark, middle_dir).base.select("event_id", "user_id", "timestamp")
    count = lambda gap, keys=(): sessions.assign_sessions(base, gap, keys).select(*keys, "session_id").distinct().count()
    assert count(timedelta(minutes=10)) == 975
    assert count(timedelta(minutes=30)) == 13
    assert count(timedelta(hours=6), ("user_id",)) == 5725


def test_histogram_keeps_empty_bins_and_last_edge(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    assert [r.n for r in session_reports.histogram(df, "x", 5).collect()] == [2, 0, 0, 0, 1]


def test_score_classes_and_shares(spark):
    df = spark.createDataFrame(
        [(1, 100.0, 10, 0.0, "a"), (2, 0.0, 1, 1.0, "b"), (3, 50.0, 5, 0.5, "a")],
        "session_id int, session_duration_minutes double, tracks_count int, skip_rate double, primary_platform string",
    )
    scored = sessions.session_score(df)
    assert {r.session_id: r.quality_category for r in scored.collect()} == {1: "High", 2: "Low", 3: "Medium"}
    assert sum(r.pct for r in session_reports.score_shares(scored).collect()) == pytest.approx(100, abs=0.01)


def test_null_keys_are_a_key(plays_of):
    df = plays_of([(1, None, "2024-01-01 10:00:00"), (2, None, "2024-01-01 10:05:00"), (3, 7, "2024-01-01 10:06:00"), (4, None, "2024-01-01 12:00:00")])
    out = {r.event_id: (r.session_id, r.is_session_start) for r in sessions.assign_sessions(df, keys=["user_id"]).collect()}
    assert out == {1: (1, True), 2: (1, False), 3: (1, True), 4: (2, True)}


def test_openers_need_no_sort_of_plays(plays_of):
    buckets = sessions.session_buckets(plays_of([(-5, 1, "2024-01-01 10:00:00"), (-9, 1, "2024-01-01 10:00:00"), (3, 1, "1960-01-01 10:00:00")]))
    plan = buckets._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert sorted(r._opener for r in buckets.collect()) == [-9, 3]
