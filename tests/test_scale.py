"""Plans: what may meet a single task, what is scanned how often, what is broadcast."""

import re

import pytest

from earshot.operators import ordered, sessions
from earshot.plans import activity, kpis, platforms, skips
from earshot.plans.workspace import Workspace


@pytest.fixture(scope="module")
def ws(spark, small_dir):
    return Workspace(spark, small_dir)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return len(re.findall(r"FileScan parquet", plan(df)))


def under_single_partition(df):
    """The operators below each single-partition exchange, nearest first."""
    lines = plan(df).splitlines()
    return [lines[i + 1 : i + 6] for i, line in enumerate(lines) if "SinglePartition" in line]


def test_whole_log_windows_see_only_small_tables(ws):
    lag = ordered.ordered_lag(ws.plays.select("event_id", "timestamp"))
    for below in under_single_partition(lag):
        assert any("HashAggregate" in line for line in below), below
    assert "hashpartitioning(_chunk" in plan(lag)


def test_session_ids_do_not_shuffle_events(ws):
    text = plan(sessions.assign_sessions(ws.plays.select("event_id", "timestamp"), ws.gap))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_one_scan_for_all_dimensions_and_kpis(ws):
    assert scans(skips.skip_by_dimension(ws.plays)) == 1
    assert scans(kpis.kpi_table(ws.plays)) == 1


def test_reports_read_only_their_columns(ws):
    text = plan(activity.hourly(ws.plays))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"hour_of_day", "ms_played", "is_skip", "percent_played"}


def test_filters_reach_the_scan(ws):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(platform,iOS\)", plan(activity.hourly(ws.plays.where("platform = 'iOS'"))))


def test_positions_are_cut_before_the_shuffle(ws):
    assert "WindowGroupLimit" in plan(sessions.position(ws.sessions, first=10))


def test_aggregates_combine_before_the_shuffle(ws):
    assert "partial_count" in plan(platforms.platform_table(ws.plays))


def test_no_cartesian_products(ws):
    from earshot.plans import registry

    queries = registry.all_queries()
    for name in ("ag3_platform_report", "ag29_executive_summary", "ag37_histogram_tracks", "rt7_insights", "se12_session_summary"):
        text = plan(queries[name](ws))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_features_move_events_three_times_after_sorting(spark, ws):
    """Without broadcasts: to the chunks, to their contents and to their sessions; all else is small."""
    from earshot.plans import feature_table

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        table = feature_table.build(ws.base, ws.gap)
        text = plan(table)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = [re.findall(r"(\w+)#", line)[0].removeprefix("_key_") for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert keys.count("_chunk") == 1 and keys.count("track_uri") == 2 and keys.count("session_id") == 2
    assert not [k for k in keys if k in ("track_name", "artist_name")]
