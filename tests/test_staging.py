"""Where staged tables go, and how joins to them behave under skew."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from earshot.operators.joins import attach
from earshot.sources import staging


class FakeContext:
    def __init__(self, master):
        self.master, self.applicationId = master, "app-1"


class FakeSession:
    def __init__(self, master, folder=None):
        self.sparkContext = FakeContext(master)
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}


def test_named_folder_is_used_and_clusters_need_one():
    assert staging.staging_root(FakeSession("yarn", "hdfs://x/checkpoints/")) == "hdfs://x/checkpoints"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.staging_root(FakeSession("spark://host:7077"))
    assert staging.staging_root(FakeSession("local[2]")) == staging.staging_root(FakeSession("local[2]"))


def test_staged_tables_lie_under_the_application(spark):
    path = staging.stage_path(spark, "x")
    assert path.startswith(staging.application_folder(spark)) and spark.sparkContext.applicationId in path


def test_dropping_removes_only_the_applications_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "staging_root", lambda _: str(tmp_path))
    staged = staging.stage(spark.range(3), "numbers")
    assert staged.count() == 3
    (tmp_path / "earshot" / "other").mkdir()
    staging.drop_staged(spark)
    assert sorted(p.name for p in Path(tmp_path, "earshot").iterdir()) == ["other"]


def test_concurrent_staging_keeps_tables_apart(spark):
    tables = staging.stage_all({f"t{i}": spark.range(i) for i in range(1, 6)})
    assert {name: t.count() for name, t in tables.items()} == {f"t{i}": i for i in range(1, 6)}


def test_a_hot_key_is_split_in_the_join(spark):
    """A third of all rows share one key; with no broadcast the staged join is still split."""
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("text")
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = attach(rows, rows.groupBy("key").agg(F.count("*").alias("n")), ["key"], "hot")
        assert joined.count() == 60_000 and joined.where("n IS NULL").count() == 0
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
