from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.operators import ranking, trends
from earshot.plans import content, platforms, retention, skips
from earshot.plans.workspace import Workspace


@pytest.fixture(scope="module")
def plays(spark, small_dir):
    return Workspace(spark, small_dir).plays


def days(spark, counts):
    rows = [(date(2024, 1, 1) + timedelta(days=i), n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "date date, daily_plays int")


def test_short_logs_have_no_trend(spark):
    row = retention.churn_trend(days(spark, [10] * 6 + [1] * 7)).first()
    assert (row.trend, row.churn_risk) == (0.0, "Low")


@pytest.mark.parametrize("last, trend, risk", [(7, -0.3, "High"), (8.5, -0.15, "Medium"), (10, 0.0, "Low")])
def test_churn_levels(spark, last, trend, risk):
    df = days(spark, [10] * 14).withColumn("daily_plays", F.when(F.col("date") > "2024-01-07", last).otherwise(10.0))
    row = retention.churn_trend(df).first()
    assert (row.trend, row.churn_risk) == (trend, risk)


def test_centred_mean_needs_seven_rows(spark):
    out = trends.centred_avg(days(spark, range(9)), {"daily_plays": "smooth"}).orderBy("date").collect()
    assert [r.smooth for r in out] == [None] * 3 + [3.0, 4.0, 5.0] + [None] * 3


def test_change_against_zero_is_null(spark):
    out = trends.pct_change(days(spark, [0, 5, 4]), "daily_plays", 1, "change").orderBy("date").collect()
    assert [r.change for r in out] == [None, None, -20.0]


def test_ranking_agrees_with_plain_windows(spark, middle_dir):
    artists = content.artist_totals(Workspace(spark, middle_dir).plays, 10)
    found = {r.artist_name: (r.plays_rank, r.plays_quintile) for r in content.artist_ranking(Workspace(spark, middle_dir).plays, k=1000).collect()}
    by = Window.orderBy(F.desc("total_plays"))
    rows = artists.select("artist_name", F.rank().over(by).alias("r")).collect()
    assert {a: r for a, (r, _) in found.items()} == {r.artist_name: r.r for r in rows}


def test_percent_rank_of_one_row(spark):
    df = spark.createDataFrame([("a", 3)], "artist_name string, n int")
    assert ranking.add_ranks(df, "n", "place", "share").first().share == 0.0


@pytest.mark.parametrize("n", [3, 5, 7, 12])
def test_ntile_of_small_tables(spark, n):

    df = spark.createDataFrame([(f"a{i:02d}", i // 2) for i in range(n)], "artist_name string, plays int")
    plain = df.withColumn("tile", F.ntile(5).over(Window.orderBy("plays", "artist_name")))
    found = ranking.add_ntile(df, 5, ["plays", "artist_name"], "tile")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, found.select(*plain.columns).collect()))


def test_subtotals_do_not_swallow_nulls(spark, plays):
    holes = plays.withColumn("platform", F.when(F.col("platform") != "mac", F.col("platform")))
    rows = platforms.rollup_report(holes).collect()
    assert sum(r.total_plays for r in rows if r.platform == "ALL PLATFORMS") == plays.count()
    assert any(r.platform is None for r in rows)


def test_shares_sum_to_hundred(plays):
    assert sum(r.market_share_pct for r in platforms.platform_report(plays).collect()) == pytest.approx(100, abs=0.3)


def test_dimension_totals_agree(plays):
    rows = skips.skip_by_dimension(plays).groupBy("dimension").agg(F.sum("total_plays").alias("n")).collect()
    assert {r.n for r in rows} == {plays.count()} and len(rows) == 4


def test_cohorts_by_join_agree(plays):
    direct = retention.cohort_retention(plays).select("cohort_week", "active_users", "weeks_since_first")
    joined = retention.with_cohort(plays).withColumn(
        "weeks_since_first", (F.datediff(F.to_date(F.date_trunc("week", "timestamp")), "cohort_week") / 7).cast("bigint")
    ).groupBy("cohort_week", "weeks_since_first").agg(F.countDistinct("track_uri").alias("active_users"))
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, joined.select(*direct.columns).collect()))
