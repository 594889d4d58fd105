import pytest
from pyspark.sql import functions as F

from earshot.constants import RAW_COLUMNS
from earshot.operators import cleaning, quality
from earshot.plans.workspace import Workspace
from earshot.sources import plays as readers


def test_known_counts_after_cleaning(spark, middle_dir):
    cleaned = cleaning.clean(Workspace(spark, middle_dir).dirty)
    row = cleaned.agg(
        F.count("*").alias("n"),
        F.sum("ms_played").cast("bigint").alias("ms"),
        F.count_if(F.col("platform") == "Unknown").alias("platform"),
        F.count_if(F.col("reason_start") == "Unknown").alias("reason"),
        F.count_if("shuffle").alias("shuffle"),
        F.count_if(F.col("ms_played") == 900_000).alias("capped"),
    ).first()
    assert tuple(row) == (9630, 545_257_390, 175, 102, 4816, 78)


def test_cleaning_twice_changes_nothing(spark, small_dir):
    once = cleaning.clean(Workspace(spark, small_dir).dirty)
    assert cleaning.dedupe(once).count() == once.count()


def test_booleans_and_numbers(spark):
    df = spark.createDataFrame([("TRUE", "1"), ("t", "x"), ("yes", None), (None, "-2")], "shuffle string, ms_played string")
    out = df.transform(cleaning.to_bool).transform(cleaning.to_numeric).collect()
    assert [r.shuffle for r in out] == [True, True, False, False]
    assert [r.ms_played for r in out] == [1.0, None, None, -2.0]
    kept = df.transform(cleaning.to_numeric).transform(cleaning.cap).transform(cleaning.drop_negative)
    assert [r.ms_played for r in kept.collect()] == [1.0]


def test_impossible_dates_are_dropped(spark):
    df = spark.createDataFrame([("31-02-2024 10:00",), ("29-02-2024 10:00",), ("2024-01-01",)], "ts string")
    assert [r.ts for r in cleaning.parse_ts(df).collect()] == ["29-02-2024 10:00"]


def test_near_duplicates_count_all_members(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01 10:00:05"), ("a", "2024-01-01 10:00:55"), ("a", "2024-01-01 10:01:00"), ("b", "2024-01-01 10:00:00")],
        "track_uri string, at string",
    ).withColumn("timestamp", F.col("at").cast("timestamp"))
    assert quality.near_dup_count(df).first()[0] == 2


def test_quartiles_interpolate(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (100,)], "ms_played int")
    row = quality.iqr_outliers(df).first()
    assert (row.q1, row.q3, row.n_outliers) == (2.0, 4.0, 1)


def test_missing_columns_stop_the_run(spark):
    df = spark.createDataFrame([("u",)], "track_uri string")
    with pytest.raises(readers.MissingColumns, match="ts"):
        readers.validate_schema(df)
    assert readers.missing_columns(df) == list(RAW_COLUMNS[1:])


def test_empty_input(spark, small_dir):
    raw = Workspace(spark, small_dir).dirty.limit(0)
    assert cleaning.clean(raw).count() == 0
    assert quality.dup_count(raw).first()[0] == 0


def test_feature_inventory_counts_names_and_types(spark):
    df = spark.createDataFrame([], "user_plays int, hour_of_day int, track_skip_rate double, session_id int")
    found = {(r.kind, r.name): r.n_columns for r in quality.feature_inventory(df).collect()}
    assert found[("all", "columns")] == 4
    assert found[("group", "temporal")] == 1 and found[("group", "behavioral")] == 1
    assert found[("group", "user")] == 1 and found[("group", "session")] == 1
    assert found[("type", "int")] == 3
