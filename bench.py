"""Times the cleaning, feature and report steps and prints one JSON line.

``clean_log`` reads a raw CSV and writes the cleaned table, ``feature_table`` reads that and writes
all 82 columns, as Parquet. The rest is run to the end through Spark's ``noop`` sink: ``wide_plays``
and ``sessions`` build the tables that the reports after them read. An untimed pass over the
smallest tables comes first, so that the times are not those of a starting JVM.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from earshot.constants import RAW_COLUMNS
from earshot.operators import cleaning
from earshot.plans import feature_table, registry
from earshot.plans.workspace import Workspace
from earshot.session import local_session
from earshot.sources import sinks
from earshot.sources.plays import read_plays, read_stage
from earshot.sources.staging import stage_path

REPORTS = (
    "ag1_top_tracks", "ag2_top_artists", "ag3_platform_report", "ag8_skip_by_dimension", "ag11_daily", "ag19_entity_stats",
    "ag22_cluster_profile", "ag25_rollup_report", "ag27_kpi_table", "wn1_trailing_avg", "wn4_artist_ranking",
    "rt1_cohort_retention", "rt5_skip_risk", "og4_rolling", "se1_sessionize", "se1_keyed_sessions", "se3_session_metrics",
    "se6_session_quality_report", "se9_session_journey", "se11_daily_sessions", "ml9_binary_metrics",
)


def run(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    ws = Workspace(spark, sf_dir, registry.GAP)
    times: dict[str, float] = {}

    def timed(name: str, make) -> None:
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    def written(name: str, make) -> str:
        start = time.perf_counter()
        path = sinks.write_stage(make(), stage_path(spark, name))
        times[name] = round(time.perf_counter() - start, 3)
        return path

    columns = ("event_id", *RAW_COLUMNS)
    raw = sinks.write_stage(ws.dirty.select(*columns), stage_path(spark, "raw"), "csv")
    cleaned = written("clean_log", lambda: cleaning.clean(read_plays(spark, raw, columns)))
    written("feature_table", lambda: feature_table.build(read_stage(spark, cleaned), ws.gap))
    timed("wide_plays", lambda: ws.plays)
    timed("sessions", lambda: ws.metrics)
    found = registry.all_queries()
    for name in REPORTS:
        timed(name, lambda name=name: found[name](ws))
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    warm_up = run(spark, os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001"))
    times = run(spark, sf_dir)
    print(json.dumps({
        "metric": "total wall time of the listed queries, after a warm-up run on the smallest tables",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "warm_up_sec": round(sum(warm_up.values()), 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
