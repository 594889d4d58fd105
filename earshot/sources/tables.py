"""Play logs derived from the ``events`` and ``part`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.constants import TS_FORMAT
from earshot.functions.numbers import cap
from earshot.functions.texts import relabel

# Which platform and reasons a row of ``events`` stands for.
PLATFORM_OF_EVENT = {
    "click": "android", "view": "iOS", "purchase": "windows", "signup": "mac", "error": "web player",
}
REASON_START = {0: "clickrow", 1: "fwdbtn", 2: "autoplay", 3: "playbtn"}
REASON_END = {0: "nextbtn", 1: "fwdbtn", 2: "endplay", 3: "backbtn"}
LONGEST_PLAY_MS = 60_000


def _reason(code: Column, reasons: dict[int, str]) -> Column:
    return F.coalesce(*[F.when(code == n, reason) for n, reason in reasons.items()], F.lit("trackdone"))


def _with_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their catalog entry. Both sides are plain scans: Spark picks the join by file size."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("k"),
        F.col("p_name").alias("track_name"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_type").alias("album_name"),
    )
    return events.join(part, "k")


def plays_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One play per event, typed, in the shape of a cleaned log."""
    start_code = (F.col("event_id") * 3 + F.col("user_id")) % 6
    end_code = (F.col("event_id") * 7 + F.col("user_id")) % 8
    return _with_catalog(spark, sf_dir).select(
        "event_id",
        "user_id",
        F.concat(F.lit("track:"), F.col("k").cast("string")).alias("track_uri"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        relabel(F.col("event_type"), PLATFORM_OF_EVENT, F.lit("web player")).alias("platform"),
        cap(F.floor(F.col("value") * 1e3 + 0.5), LONGEST_PLAY_MS).cast("bigint").alias("ms_played"),
        "track_name",
        "artist_name",
        "album_name",
        _reason(start_code, REASON_START).alias("reason_start"),
        _reason(end_code, REASON_END).alias("reason_end"),
        ((F.col("event_id") + F.col("user_id")) % 3 == 0).alias("shuffle"),
        (F.col("event_id") % 19 == 0).alias("skipped"),
    )


def dirty_plays_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as raw text with faults: bad, empty and missing values and repeated rows."""
    n = F.col("event_id")
    source = _with_catalog(spark, sf_dir)
    rows = source.select(
        "event_id",
        F.concat(F.lit("track:"), F.col("k").cast("string")).alias("track_uri"),
        F.when(n % 103 == 0, "bad").otherwise(F.date_format(F.col("ts").cast("timestamp"), TS_FORMAT)).alias("ts"),
        F.when(n % 101 == 0, "")
        .when(n % 131 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), "event_type"))
        .alias("platform"),
        F.when(n % 107 == 0, "-1")
        .when(n % 109 == 0, "abc")
        .when(n % 113 == 0, F.lit(None).cast("string"))
        .when(n % 127 == 0, "1200000")
        .otherwise(F.floor(F.col("value") * 1e3 + 0.5).cast("bigint").cast("string"))
        .alias("ms_played"),
        F.when(n % 89 != 0, F.col("track_name")).alias("track_name"),
        "artist_name",
        "album_name",
        F.when(n % 97 != 0, "trackdone").alias("reason_start"),
        F.lit("endplay").alias("reason_end"),
        F.when(n % 4 == 0, "TRUE").when(n % 4 == 1, "false").when(n % 4 == 2, "T").otherwise("x").alias("shuffle"),
        F.when(n % 19 == 0, "True").otherwise("False").alias("skipped"),
        F.when(n % 83 == 0, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
