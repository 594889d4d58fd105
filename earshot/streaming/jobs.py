"""Streaming sessions, activity, de-duplication and scoring.

Each function maps a streaming (or batch) DataFrame to another; ``run_to_table`` drains what is
there into a Parquet table. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.numbers import flag
from earshot.learning.models import score
from earshot.sources.staging import stage_path


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a staged table as a stream."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_sessions(plays: DataFrame, entity: Sequence[str] = ("user_id",), gap: str = "30 minutes", lateness: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """Sessions per entity. A session is final once the watermark passes its last play plus the gap."""
    grouped = plays.withWatermark(ts, lateness).groupBy(*entity, F.session_window(ts, gap).alias("_w")).agg(
        F.min(ts).alias("session_start"),
        F.max(ts).alias("session_end"),
        F.count("*").alias("tracks"),
        (F.sum("ms_played") / 6e4).alias("minutes"),
        F.avg(flag(F.col("is_skip"))).alias("skip_rate"),
    )
    return grouped.drop("_w")


def stream_kpis(plays: DataFrame, size: str = "1 hour", slide: str | None = None, lateness: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """Plays, skip rate and hours per tumbling or sliding window."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = plays.withWatermark(ts, lateness).groupBy(span.alias("_w")).agg(
        F.count("*").alias("plays"),
        F.avg(flag(F.col("is_skip"))).alias("skip_rate"),
        (F.sum("ms_played") / 3.6e6).alias("hours"),
    )
    return grouped.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "plays", "skip_rate", "hours"
    )


def stream_dedupe(plays: DataFrame, keys: Sequence[str] = ("event_id",), lateness: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """First copy of each key; keys are forgotten after the lateness."""
    return plays.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def stream_score(plays: DataFrame, model: PipelineModel) -> DataFrame:
    """Prediction and skip probability on each row as it arrives."""
    return score(model, plays)


def close_stream(folder: str, like: DataFrame, ts: str = "timestamp") -> None:
    """End an input folder by one row of far later time. It moves the watermark past everything before it, so that
    all groups become final; its own group never does."""
    spark = like.sparkSession
    far = F.lit("9999-01-01").cast(like.schema[ts].dataType)
    spark.range(1).select(*[(far if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema]).write.mode("append").parquet(folder)


def run_to_table(stream: DataFrame, name: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Process everything available in append mode and read the written table. With ``close``, which ends the input,
    the query runs on until the groups that were still open are written too."""
    spark = stream.sparkSession
    path = stage_path(spark, name)
    for end in (None, close) if close else (None,):
        if end:
            end()
        query = (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", f"{path}-checkpoint")
            .trigger(availableNow=True)
            .start(path)
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
