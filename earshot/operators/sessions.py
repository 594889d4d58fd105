"""Gap sessions over the whole log or per key.

A session breaks where the gap between neighbours exceeds the limit. Cut time into buckets no
wider than that limit: two plays in one bucket can never be a break apart, so a bucket lies in
one session, and breaks depend only on each bucket's first and last time. The bucket table is
bounded by the calendar span over the gap, not by the number of plays, so events are only
partially aggregated and then joined to a small map: the log is never sorted for this.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from earshot import constants as K
from earshot.functions.numbers import exact_mean, flag, ratio, right_closed_bin, round_half_even, round_half_up
from earshot.functions.times import day_part, micros_between, minutes_between
from earshot.operators.joins import attach, join_on, normalise_by_max, with_distinct, with_modes
from earshot.operators.ordered import order_log, previous
from earshot.sources.staging import stage

GAP = timedelta(minutes=K.SESSION_GAP_MINUTES)
SPAN_BUCKETS = 4096


def _gap_micros(gap: timedelta) -> int:
    return int(gap.total_seconds() * 1_000_000)


def time_bucket(ts: str, gap: timedelta) -> Column:
    width = _gap_micros(gap)
    return F.expr(f"(unix_micros(`{ts}`) - pmod(unix_micros(`{ts}`), {width}L)) div {width}L")


def session_buckets(events: DataFrame, gap: timedelta = GAP, keys: Sequence[str] = (), ts: str = "timestamp", tiebreak: str = "event_id") -> DataFrame:
    """First and last time of each (keys, bucket), and the play that opens it; combined before the shuffle."""
    return (
        events.groupBy(*keys, time_bucket(ts, gap).alias("_bucket"))
        .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), _opener(events, ts, tiebreak).alias("_opener"))
    )


def _opener(events: DataFrame, ts: str, tiebreak: str) -> Column:
    """The tie-break of the earliest play. Whole-number ones are packed behind the time into one decimal: unlike a
    struct that is a hash aggregate, so plays are not sorted."""
    if not isinstance(events.schema[tiebreak].dataType, T.IntegralType):
        return F.min(F.struct(ts, tiebreak))[tiebreak]
    whole, shift = "decimal(20,0)", F.lit("18446744073709551616").cast("decimal(20,0)")
    up = F.lit(1 << 62).cast(whole) + F.lit(1 << 62).cast(whole)
    packed = (F.unix_micros(ts).cast(whole) * shift + (F.col(tiebreak).cast(whole) + up)).cast("decimal(38,0)")
    return (F.pmod(F.min(packed), shift.cast("decimal(38,0)")) - up).cast(events.schema[tiebreak].dataType)


def session_map(buckets: DataFrame, gap: timedelta = GAP, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bucket) -> session_id; ids count from 1, per key if there are keys.

    ``buckets`` should be staged, as it is read more than once. Over the whole log it is numbered in two levels;
    with keys, one key's buckets are at most the span over the gap. The map is staged, so Spark knows its size
    when it picks the join.
    """
    width = _gap_micros(gap)

    def starts(prev: Column) -> Column:
        return F.when(prev.isNull() | (micros_between(prev, F.col("_first")) > width), 1).otherwise(0)

    if keys:
        w = Window.partitionBy(*keys).orderBy("_bucket")
        marked = buckets.withColumn("_starts", starts(F.lag("_last").over(w)))
        numbered = marked.withColumn("session_id", F.sum("_starts").over(w))
    else:
        numbered = _number_in_spans(buckets, starts)
    mapped = numbered.select(*keys, "_bucket", "_opener", "_starts", F.col("session_id").cast("bigint").alias("session_id"))
    return stage(mapped, "session_map")


def _number_in_spans(buckets: DataFrame, starts: Callable[[Column], Column]) -> DataFrame:
    """Lag and running count over buckets in two levels, so no task sees more than one span."""
    buckets = buckets.withColumn("_span", F.expr(f"_bucket div {SPAN_BUCKETS}"))
    local = Window.partitionBy("_span").orderBy("_bucket")
    spans = Window.orderBy("_span")
    edges = buckets.groupBy("_span").agg(F.max("_last").alias("_span_last")).select(
        "_span", F.lag("_span_last").over(spans).alias("_carry")
    )
    prev = F.coalesce(F.lag("_last").over(local), "_carry")
    marked = buckets.join(edges, "_span").withColumn("_prev", prev).withColumn("_starts", starts(F.col("_prev")))
    before = F.coalesce(F.sum("_n").over(spans.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = marked.groupBy("_span").agg(F.sum("_starts").alias("_n")).select("_span", before.alias("_before"))
    return marked.join(offsets, "_span").withColumn("session_id", F.col("_before") + F.sum("_starts").over(local))


def join_sessions(events: DataFrame, mapped: DataFrame, gap: timedelta = GAP, keys: Sequence[str] = (), ts: str = "timestamp", tiebreak: str = "event_id") -> DataFrame:
    """Adds ``session_id`` and ``is_session_start`` from a bucket map."""
    joined = join_on(events.withColumn("_bucket", time_bucket(ts, gap)), mapped, [*keys, "_bucket"], "inner")
    opens = (F.col("_starts") == 1) & (F.col(tiebreak) == F.col("_opener"))
    return joined.withColumn("is_session_start", opens).drop("_bucket", "_opener", "_starts")


def assign_sessions(events: DataFrame, gap: timedelta = GAP, keys: Sequence[str] = (), ts: str = "timestamp", tiebreak: str = "event_id") -> DataFrame:
    """Adds ``session_id`` and ``is_session_start``."""
    buckets = stage(session_buckets(events, gap, keys, ts, tiebreak), "session_buckets")
    return join_sessions(events, session_map(buckets, gap, keys), gap, keys, ts, tiebreak)


def sessionize(events: DataFrame, gap: timedelta = GAP, keys: Sequence[str] = (), ts: str = "timestamp", tiebreak: str = "event_id", chunk_rows: int | None = None) -> DataFrame:
    """Previous time, seconds since it, start flag and session id on every play."""
    log = order_log(events, (ts, tiebreak), keys, chunk_rows)
    seen = log.history({"prev_timestamp": previous(ts)}, reach=1)
    timed = seen.withColumn("time_since_last", micros_between(F.col("prev_timestamp"), F.col(ts)) / 1e6)
    return assign_sessions(timed.drop("row_index"), gap, keys, ts, tiebreak)


def position(sessions: DataFrame, first: int, tiebreak: str = "event_id") -> DataFrame:
    """The first plays of each session with ``track_position_in_session`` from 1.

    The limit lets Spark cut each partition before the shuffle, so a long session costs nothing.
    For every play's position use ``position_from_index``.
    """
    w = Window.partitionBy("session_id").orderBy("timestamp", tiebreak)
    placed = sessions.withColumn("track_position_in_session", F.row_number().over(w))
    return placed.where(F.col("track_position_in_session") <= first)


def position_from_index(indexed: DataFrame) -> DataFrame:
    """The same position from ``row_index``: a session is a contiguous run, so no window is needed."""
    firsts = indexed.groupBy("session_id").agg(F.min("row_index").alias("_first_index"))
    joined = attach(indexed, firsts, ["session_id"], "session_firsts")
    place = (F.col("row_index") - F.col("_first_index") + 1).cast("int")
    return joined.withColumn("track_position_in_session", place).drop("_first_index")


def session_diversity(sessions: DataFrame) -> DataFrame:
    """Distinct artists of the session on every play."""
    artists = sessions.groupBy("session_id").agg(F.countDistinct("artist_name").alias("artist_diversity_in_session"))
    return attach(sessions, artists, ["session_id"], "session_artists")


def _times() -> list[Column]:
    return [F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"), F.count("*").alias("n")]


def session_report(sessions: DataFrame, min_tracks: int = 2, k: int = 50) -> DataFrame:
    """The short report: the first ``k`` sessions with at least ``min_tracks`` plays."""
    grouped = sessions.groupBy("session_id").agg(
        *_times(),
        F.sum("ms_played").alias("ms"),
        F.avg(flag(F.col("is_skip"))).alias("skip"),
    ).where(F.col("n") >= min_tracks)
    grouped = with_modes(grouped, sessions, ["session_id"], {"primary_platform": "platform"})
    return grouped.select(
        "session_id",
        "session_start",
        "session_end",
        F.col("n").alias("tracks_in_session"),
        round_half_up(F.col("ms") / 6e4, 1).alias("total_session_minutes"),
        round_half_up(minutes_between(F.col("session_start"), F.col("session_end")), 1).alias("session_duration_minutes"),
        round_half_up(F.col("skip") * 1e2, 1).alias("session_skip_rate"),
        "primary_platform",
    ).orderBy("session_id").limit(k)


def session_metrics(sessions: DataFrame, min_tracks: int = 2) -> DataFrame:
    """The full session table, 18 columns."""
    grouped = sessions.groupBy("session_id").agg(
        *_times(),
        F.sum("ms_played").alias("ms"),
        F.avg(flag(F.col("is_skip"))).alias("skip"),
        exact_mean(F.col("percent_played")).alias("pct"),
        F.avg(flag(F.col("shuffle"))).alias("shuffled"),
    ).where(F.col("n") >= min_tracks)
    grouped = with_modes(grouped, sessions, ["session_id"], {"primary_platform": "platform"})
    grouped = with_distinct(grouped, sessions, ["session_id"], {"unique_tracks": "track_uri", "unique_artists": "artist_name"})
    n, pct, skip = F.col("n"), F.col("pct"), F.col("skip")
    span = micros_between(F.col("session_start"), F.col("session_end"))
    quality = (
        F.when((n >= 10) & (pct >= 70) & (skip <= 0.3), "High Quality")
        .when((n >= 5) & (pct >= 50) & (skip <= 0.5), "Medium Quality")
        .otherwise("Low Quality")
    )
    hour = F.hour("session_start")
    return grouped.select(
        "session_id",
        "session_start",
        "session_end",
        n.alias("tracks_count"),
        "unique_tracks",
        "unique_artists",
        round_half_up(span / 6e7, 1).alias("session_duration_minutes"),
        round_half_up(F.col("ms") / 6e4, 1).alias("total_listening_minutes"),
        round_half_up(F.col("ms") / 1e3 / n, 1).alias("avg_track_duration"),
        round_half_up(skip * 1e2, 1).alias("session_skip_rate"),
        round_half_up(pct, 1).alias("avg_percent_played"),
        round_half_up(ratio(F.col("ms") * 1e5, span), 1).alias("listening_efficiency"),
        "primary_platform",
        round_half_up(F.col("shuffled") * 1e2, 1).alias("shuffle_usage_pct"),
        hour.alias("session_start_hour"),
        (F.dayofweek("session_start") - 1).alias("session_start_dow"),
        day_part(hour).alias("session_time_period"),
        quality.alias("session_quality"),
    )


def session_stats(sessions: DataFrame) -> DataFrame:
    """Session statistics of the exploratory report: two-digit half-even rounding."""
    grouped = sessions.groupBy("session_id").agg(
        *_times(),
        F.sum("ms_played").alias("ms"),
        F.avg(flag(F.col("is_skip"))).alias("skip"),
    )
    grouped = with_modes(grouped, sessions, ["session_id"], {"primary_platform": "platform"})
    return grouped.select(
        "session_id",
        "session_start",
        "session_end",
        F.col("n").alias("tracks_count"),
        round_half_even(F.col("ms") / 1e3, 2).alias("total_seconds"),
        round_half_even(F.col("skip"), 2).alias("skip_rate"),
        "primary_platform",
        round_half_even(minutes_between(F.col("session_start"), F.col("session_end")), 1).alias("session_duration_minutes"),
        round_half_even(F.col("ms") / 6e4, 1).alias("total_minutes"),
    )


def session_feature_table(sessions: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Per-session features for models; rates are rounded before the quality thresholds.

    ``extra`` aggregates join the same pass.
    """
    grouped = sessions.groupBy("session_id").agg(
        *_times(),
        *extra,
        round_half_even(F.avg(flag(F.col("is_skip"))), 3).alias("session_skip_rate"),
        round_half_even(exact_mean(F.col("engagement_score")), 3).alias("session_avg_engagement"),
    )
    known = ("session_id", "session_start", "session_end", "n", "session_skip_rate", "session_avg_engagement")
    n, skip, engaged = F.col("n"), F.col("session_skip_rate"), F.col("session_avg_engagement")
    quality = (
        F.when((n >= 10) & (skip <= 0.3) & (engaged >= 0.7), "High")
        .when((n >= 5) & (skip <= 0.5), "Medium")
        .otherwise("Low")
    )
    return grouped.select(
        "session_id",
        n.alias("session_track_count"),
        "session_skip_rate",
        "session_avg_engagement",
        round_half_even(minutes_between(F.col("session_start"), F.col("session_end")), 1).alias("session_duration_minutes"),
        quality.alias("session_quality"),
        *[c for c in grouped.columns if c not in known],
    )


def session_features(sessions: DataFrame) -> DataFrame:
    """Plays with the features of their session."""
    return attach(sessions, session_feature_table(sessions), ["session_id"], "session_features")


def session_score(stats: DataFrame) -> DataFrame:
    """Score 0-100 from duration, plays and completion, each against the best session."""
    best = normalise_by_max(
        stats.withColumn("kept", 1 - F.col("skip_rate")), ["session_duration_minutes", "tracks_count", "kept"]
    )
    score = (
        F.col("session_duration_minutes_norm") * 0.3 + F.col("tracks_count_norm") * 0.3 + F.col("kept_norm") * 0.4
    ) * 100
    return best.withColumn("session_quality_score", score).select(
        *stats.columns,
        "session_quality_score",
        right_closed_bin(F.col("session_quality_score"), K.SCORE_BINS).alias("quality_category"),
    )
