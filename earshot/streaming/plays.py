"""Features and scores of plays as they stream in, with keyed state.

A listener's plays wait in state until their session can get no further play: the watermark has passed its last one plus
the gap. Then the session is put in order and its plays get what depends on neighbours: the play before, means over the
last plays, and the session's own measures. The last plays before it come from a small ring that is kept between
sessions. A timer for the end of the newest session wakes a listener without new plays. Plays behind the watermark are
late and dropped by Spark. State holds the open sessions and a ring of ``ROLLING`` plays for each listener.

``keyed_features`` gives the same columns in a batch; models are trained on them, and a stream that has ended has the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import WindowSpec

from earshot.functions.numbers import exact_mean, exact_sum
from earshot.learning.models import score
from earshot.operators.ordered import fill_previous, order_log, previous
from earshot.operators.sessions import assign_sessions
from earshot.sources.staging import stage

ROLLING = 5
_PLAY = "event_id bigint, at bigint, platform string, is_skip boolean, percent_played double, engagement_score double"
_FEATURES = (
    "event_id bigint, user_id bigint, prev_platform string, platform_switch boolean, prev_track_skip boolean, prev_track_completion double, "
    "rolling_5_skip_rate double, rolling_5_avg_completion double, track_position_in_session bigint, session_track_count bigint, "
    "session_skip_rate double, session_avg_engagement double, session_duration_minutes double"
)
FEATURES = tuple(c.strip().split(" ")[0] for c in _FEATURES.split(","))
LISTENER_GAP = timedelta(hours=6)


def _mean(values: Sequence[float | None]) -> float | None:
    """In whole billionths, as ``exact_mean`` takes it, so that it does not depend on the order."""
    known = [round(v * 1e9) for v in values if v is not None]
    return sum(known) / 1e9 / len(known) if known else None


def _rolling_mean(value: Column) -> Callable[[WindowSpec], Column]:
    def over(w: WindowSpec) -> Column:
        last = w.rowsBetween(1 - ROLLING, 0)
        return exact_sum(value).over(last).cast("double") / 1e9 / F.count(value).over(last)

    return over


def _session_rows(user: int | None, plays: Sequence[tuple], ring: list[tuple]) -> Iterator[Row]:
    """Features of one session's plays in order; ``ring`` holds the plays before them and is moved on."""
    count = len(plays)
    skip_rate = _mean([float(p[3]) if p[3] is not None else None for p in plays])
    engagement = _mean([p[5] for p in plays])
    minutes = (plays[-1][1] - plays[0][1]) / 6e7
    for i, play in enumerate(plays):
        before = ring[-1] if ring else None
        last = [*ring[-(ROLLING - 1) :], play]
        skips = _mean([1.0 if p[3] else 0.0 for p in last])
        ring.append(play)
        del ring[:-ROLLING]
        switched = True if before is None or before[2] is None or play[2] is None else before[2] != play[2]
        yield Row(
            event_id=play[0], user_id=user, prev_platform=before and before[2], platform_switch=switched,
            prev_track_skip=bool(before and before[3]), prev_track_completion=before[4] if before and before[4] is not None else 0.0,
            rolling_5_skip_rate=skips, rolling_5_avg_completion=_mean([p[4] for p in last]), track_position_in_session=i + 1,
            session_track_count=count, session_skip_rate=skip_rate, session_avg_engagement=engagement, session_duration_minutes=minutes,
        )


class _Listener(StatefulProcessor):
    def __init__(self, gap: timedelta):
        self.gap = int(gap.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _PLAY)
        self.ring = handle.getListState("ring", _PLAY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [tuple(r[c] for c in ("event_id", "at", "platform", "is_skip", "percent_played", "engagement_score")) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(self._wake(max(p[1] for p in new)))
        return iter(())

    def _wake(self, last: int) -> int:
        """In milliseconds: when a session that ends now is over."""
        return -(-(last + self.gap) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        plays = sorted((tuple(p) for p in self.waiting.get()), key=lambda p: (p[1], p[0]))
        ring = [tuple(p) for p in self.ring.get()]
        over = timerValues.getCurrentWatermarkInMs() * 1000 - self.gap
        first, out = 0, []
        for i, play in enumerate(plays):
            ends = i + 1 == len(plays) or plays[i + 1][1] - play[1] > self.gap
            if ends and play[1] <= over:
                out += _session_rows(key[0], plays[first : i + 1], ring)
                first = i + 1
            elif ends:
                break
        if first:
            self.ring.put(ring) if ring else self.ring.clear()
            self.waiting.put(plays[first:]) if plays[first:] else self.waiting.clear()
        return iter(out)

    def close(self) -> None:
        pass


def stream_features(plays: DataFrame, gap: timedelta = LISTENER_GAP, lateness: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """``FEATURES`` of every play (``event_id, user_id, timestamp, platform, is_skip, percent_played, engagement_score``)
    once its session is over. Needs the RocksDB state store."""
    plays.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = plays.withWatermark(ts, lateness).select(
        F.col("user_id").cast("bigint"), ts, F.col("event_id").cast("bigint"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), "platform", "is_skip",
        F.col("percent_played").cast("double"), F.col("engagement_score").cast("double"),
    )
    return rows.groupBy("user_id").transformWithState(_Listener(gap), _FEATURES, outputMode="Append", timeMode="EventTime")


def keyed_features(plays: DataFrame, gap: timedelta = LISTENER_GAP, ts: str = "timestamp") -> DataFrame:
    """The same features in a batch."""
    flag = F.when(F.col("is_skip"), 1.0).otherwise(0.0)
    sessions = assign_sessions(plays.select("event_id", "user_id", ts, "platform", "is_skip", "percent_played", "engagement_score"), gap, ["user_id"])
    log = order_log(stage(sessions, "keyed_sessions"), (ts, "event_id"), ("user_id",))
    looks = {
        "prev_platform": previous("platform"), "prev_track_skip": previous("is_skip"), "prev_track_completion": previous("percent_played"),
        "rolling_5_skip_rate": _rolling_mean(flag), "rolling_5_avg_completion": _rolling_mean(F.col("percent_played")),
    }
    seen = stage(fill_previous(log.history(looks, reach=ROLLING)), "keyed_history")
    of = ["user_id", "session_id"]
    length = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 6e7
    measures = seen.groupBy(*of).agg(
        F.count("*").alias("session_track_count"), exact_mean(F.when(F.col("is_skip").isNotNull(), flag)).alias("session_skip_rate"),
        exact_mean(F.col("engagement_score")).alias("session_avg_engagement"), length.alias("session_duration_minutes"), F.min("row_index").alias("_first"),
    )
    measures = stage(measures, "keyed_sessions_measured").withColumnsRenamed({c: f"_{c}" for c in of})
    same = seen["user_id"].eqNullSafe(measures["_user_id"]) & seen["session_id"].eqNullSafe(measures["_session_id"])
    placed = seen.join(measures, same).withColumn("track_position_in_session", F.col("row_index") - F.col("_first") + 1)
    return placed.select(*FEATURES)


def play_matrix(featured: DataFrame, label: bool = True) -> DataFrame:
    """The numbers a model sees, nulls as zero; the label needs ``is_skip``."""
    names = [c for c in FEATURES if c not in ("event_id", "user_id", "prev_platform")]
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]
    return featured.select("event_id", *([F.col("is_skip").cast("int").alias("label")] if label else []), *numbers)


def stream_scores(plays: DataFrame, model: PipelineModel, gap: timedelta = LISTENER_GAP, lateness: str = "1 hour") -> DataFrame:
    """``event_id, prediction, score`` of raw plays on a stream, by a model trained on ``play_matrix``."""
    return score(model, play_matrix(stream_features(plays, gap, lateness), label=False)).select("event_id", "prediction", "score")
