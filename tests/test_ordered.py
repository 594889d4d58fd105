"""Chunked operators against plain windows on random logs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.operators import ordered


@pytest.fixture(scope="module")
def log(spark):
    """Many equal times, a key with a third of the rows, nulls in the value."""
    random.seed(7)
    rows = []
    for i in range(1200):
        key = 0 if random.random() < 0.34 else random.randint(1, 60)
        value = None if random.random() < 0.1 else random.randint(0, 9)
        minute = 0 if random.random() < 0.3 else random.randint(0, 4000)
        rows.append((i, key, minute, value, random.random() < 0.5))
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, minute int, value int, is_skip boolean")
    return df.withColumn("timestamp", F.timestamp_seconds(F.col("minute") * 60)).drop("minute")


def same(a, b, *cols):
    left = sorted(map(tuple, a.select("event_id", *cols).collect()))
    right = sorted(map(tuple, b.select("event_id", *cols).collect()))
    assert left == right


@pytest.mark.parametrize("keys", [(), ("user_id",)])
@pytest.mark.parametrize("chunk", [5, 37, 5000])
def test_history_equals_plain_window(log, keys, chunk):
    w = Window.partitionBy(*keys).orderBy("timestamp", "event_id")
    plain = log.withColumns({
        "before": F.lag("value").over(w), "third": F.lag("value", 3).over(w), "mean": F.avg("value").over(w.rowsBetween(-4, 0)),
        "past": F.sum("value").over(w.rowsBetween(-5, -1)),
    })
    found = ordered.order_log(log, keys=keys, chunk_rows=chunk).history({
        "before": ordered.previous("value"), "third": ordered.previous("value", 3),
        "mean": ordered.rolling_mean(F.col("value"), 5), "past": lambda v: F.sum("value").over(v.rowsBetween(-5, -1)),
    }, reach=5)
    same(plain, found, "before", "third", "mean", "past")


@pytest.mark.parametrize("keys", [(), ("user_id",)])
@pytest.mark.parametrize("chunk", [11, 5000])
def test_running_sum_equals_plain_window(log, keys, chunk):
    w = Window.partitionBy(*keys).orderBy("timestamp", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = log.withColumn("running", F.sum(F.col("is_skip").cast("int")).over(w))
    same(plain, ordered.order_log(log, keys=keys, chunk_rows=chunk).running_sum(F.col("is_skip").cast("int")), "running")


def test_index_is_dense_and_ordered(log):
    plain = log.withColumn("row_index", F.row_number().over(Window.orderBy("timestamp", "event_id")))
    same(plain, ordered.order_log(log).rows, "row_index")


def test_long_reach_widens_the_chunks(log):
    short, long = (ordered.order_log(log, chunk_rows=n).history({"x": ordered.previous("value", 4)}, reach=4) for n in (3, 1000))
    assert sorted(map(tuple, short.collect()), key=repr) == sorted(map(tuple, long.collect()), key=repr)
    with pytest.raises(ValueError):
        ordered.order_log(log).history({"x": ordered.previous("value")}, reach=0)


def test_empty_and_single_row(log):
    assert ordered.order_log(log.limit(0)).history({"b": ordered.previous("value")}, reach=1).count() == 0
    one = ordered.ordered_lag(log.where("event_id = 3").select("event_id", "timestamp")).first()
    assert one.prev_timestamp is None and one.gap_seconds is None


def test_a_hot_time_is_spread_over_range_partitions(log):
    """A third of the rows share one timestamp; the tie-break lets the range bounds split it."""
    hot = log.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    by = ["timestamp", "event_id"]
    sizes = [r["count"] for r in hot.repartitionByRange(4, *by).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.5 * log.count()


def test_first_play_counts_as_a_switch(spark):
    rows = [(1, "a", False, 1.0), (2, "a", True, 2.0), (3, "b", False, 3.0)]
    df = spark.createDataFrame(rows, "event_id bigint, platform string, is_skip boolean, percent_played double")
    df = df.withColumn("timestamp", F.timestamp_seconds("event_id"))
    for first in (True, False):
        out = ordered.with_previous(ordered.order_log(df), first).orderBy("event_id").collect()
        assert [r.platform_switch for r in out] == [first, False, True]
        assert [r.prev_track_skip for r in out] == [False, False, True]
        assert [r.prev_track_completion for r in out] == [0.0, 1.0, 2.0]
