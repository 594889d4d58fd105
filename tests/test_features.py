from pyspark.sql import functions as F

from earshot import constants as K
from earshot.functions import numbers, texts, times
from earshot.operators import entities, features


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (120.0,), (120.1,), (180.0,), (240.0,), (300.0,), (301.0,), (None,)], "s double")
    got = [r[0] for r in df.select(numbers.right_closed_bin(F.col("s"), K.LENGTH_BINS)).collect()]
    assert got == [None, "<2min", "<2min", "2-3min", "2-3min", "3-4min", "4-5min", "5min+", None]


def test_popularity_edges(spark):
    df = spark.createDataFrame([(5, 10), (6, 11), (20, 50), (21, 51), (50, 200), (51, 201)], "track_play_count int, artist_play_count int")
    assert values(entities.popularity(df), "track_popularity", "artist_popularity") == [
        ("Rare", "Niche"), ("Uncommon", "Emerging"), ("Uncommon", "Emerging"), ("Popular", "Mainstream"),
        ("Popular", "Mainstream"), ("Very Popular", "Superstar"),
    ]


def test_parts_of_the_day(spark):
    df = spark.createDataFrame([(h,) for h in (0, 5, 6, 11, 12, 17, 18, 21, 22, 23)], "h int")
    got = [r[0] for r in df.select(times.day_part(F.col("h"))).collect()]
    assert got == ["Night", "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Night", "Night"]


def test_skip_and_quality_edges(spark):
    df = spark.createDataFrame(
        [(29.99, False, "trackdone"), (30.0, False, "trackdone"), (50.0, True, "trackdone"), (80.0, False, "backbtn"), (79.9, False, "fwdbtn")],
        "percent_played double, skipped boolean, reason_end string",
    )
    out = df.transform(features.add_is_skip).transform(features.add_quality)
    assert values(out, "is_skip", "listening_quality") == [
        (True, "Low"), (False, "Low"), (True, "Medium"), (True, "High"), (False, "Medium"),
    ]


def test_zero_length_track_and_cap_keep_nulls(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (20, 10), (None, 10)], "ms_played bigint, estimated_track_length_ms bigint")
    assert [r[0] for r in values(features.add_percent_played(df), "percent_played")] == [0.0, 50.0, 100.0, None]


def test_rounding(spark):
    df = spark.createDataFrame([(0.25, -0.25), (0.35, -0.04), (2.5, 2.5)], "x double, y double")
    got = values(df, numbers.round_half_up(F.col("x"), 1), numbers.round_half_even(F.col("x"), 1), numbers.round_signed(F.col("y"), 1))
    assert got == [(0.3, 0.2, -0.3), (0.4, 0.4, 0.0), (2.5, 2.5, 2.5)]


def test_exact_mean_does_not_depend_on_order(spark):
    rows = [(i * 0.1 + 1e-3,) for i in range(1, 2000)]
    means = set()
    for seed in range(3):
        df = spark.createDataFrame(rows, "x double").orderBy(F.rand(seed)).repartition(seed + 1)
        means.add(df.agg(numbers.exact_mean(F.col("x"))).first()[0])
    assert len(means) == 1


def test_texts(spark):
    df = spark.createDataFrame([("  a ",), ("",), (None,), ("123456789",)], "t string")
    assert [r[0] for r in values(df, texts.tidy(F.col("t")))] == ["a", "Unknown", "Unknown", "123456789"]
    assert [r[0] for r in values(df, texts.ellipsis(F.col("t"), 5))] == ["  a ", "", None, "12345..."]


def test_codes_and_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "platform string")
    assert sorted(values(features.encode_sorted(df, ["platform"]), "platform", "platform_encoded"), key=str) == sorted(
        [("b", 1), ("b", 1), ("a", 0), (None, -1)], key=str
    )


def test_one_play_entity_lives_one_day(plays_of):
    df = plays_of([(1, 1, "2024-01-01 10:00:00")]).transform(features.wide_plays)
    row = entities.entity_stats(df).first()
    assert (row.play_count, row.lifespan_days, row.frequency) == (1, 1, 1.0)


def test_mode_takes_the_smallest_on_ties(plays_of):
    rows = [(i, 1, f"2024-01-01 10:0{i}:00") for i in range(4)]
    df = plays_of(rows, platform=F.when(F.col("event_id") % 2 == 0, "mac").otherwise("iOS")).transform(features.wide_plays)
    assert entities.entity_stats(df).first().preferred_platform == "iOS"


def test_selected_features_are_those_that_exist(spark):
    df = spark.createDataFrame([(None, True)], "a int, b boolean")
    assert values(features.select_available(df, ["a", "b", "c"]), "a", "b") == [(0.0, 1.0)]


def test_rollup_adds_up_to_the_direct_tables(spark, middle_dir):
    from earshot.plans.workspace import Workspace

    plays = Workspace(spark, middle_dir).plays
    # one name under two uris, so that the rollup's keys do not nest
    plays = plays.withColumn("track_uri", F.concat("track_uri", F.lit("/"), (F.col("event_id") % 2).cast("string")))
    rollup = entities.content_rollup(plays)
    pairs = (
        (entities.rolled_entities(rollup), entities.entity_features(plays)),
        (entities.rolled_tracks(rollup), entities.track_stats(plays)),
        (entities.rolled_artists(rollup), entities.artist_stats(plays)),
    )
    for rolled, direct in pairs:
        assert sorted(map(tuple, rolled.select(*direct.columns).collect())) == sorted(map(tuple, direct.collect()))


def test_sparse_one_hot_of_very_many_values(spark):
    """A million categories: one index a row, no list of names, usable as a vector column."""
    n = 1_000_000
    df = spark.range(n + 500).select((F.col("id") % n).alias("id"), F.concat(F.lit("c"), F.lpad((F.col("id") % n).cast("string"), 7, "0")).alias("name"))
    found = features.one_hot_sparse(df, "name")
    size = found.where("id in (0, 7, 999999)").orderBy("id").collect()
    assert [(r.name_onehot.size, list(r.name_onehot.indices), list(r.name_onehot.values)) for r in size][0] == (n, [0], [1.0])
    assert {int(r.id): int(r.name_onehot.indices[0]) for r in size} == {0: 0, 7: 7, 999999: 999999}
    assert found.count() == n + 500


def test_sparse_one_hot_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "name string")
    vectors = sorted((r.name or "", r.v.toArray().tolist()) for r in features.one_hot_sparse(df, "name", "v").collect())
    assert vectors == [("", [0.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [0.0, 1.0])]
    assert features.one_hot_sparse(df.limit(0), "name").count() == 0
