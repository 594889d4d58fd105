"""Shared tables of one data set, each staged once and read by many reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.learning.matrix import skip_matrix, split
from earshot.operators import features, sessions
from earshot.operators.ordered import OrderedLog, order_log
from earshot.plans import feature_table
from earshot.session import configure
from earshot.sources import tables
from earshot.sources.staging import stage

_staged: dict[tuple[str, str, str], DataFrame] = {}
_kept: dict[tuple[str, str, str], Any] = {}


class Workspace:
    """Plays, sessions and features derived from the tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str, gap: timedelta = sessions.GAP):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self.gap = gap

    def _key(self, name: str) -> tuple[str, str, str]:
        """A changed input is another input."""
        return self.spark.sparkContext.applicationId, self._print, name

    @cached_property
    def _print(self) -> str:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.sf_dir)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return ";".join([self.sf_dir, *sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files)])

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = self._key(name)
        if key not in _staged:
            _staged[key] = stage(make(), name)
        return _staged[key]

    def keep(self, name: str, make: Callable[[], Any]) -> Any:
        """Fitted models and the like, made once."""
        key = self._key(name)
        if key not in _kept:
            _kept[key] = make()
        return _kept[key]

    def _gap_name(self, name: str) -> str:
        return f"{name}_{int(self.gap.total_seconds())}s"

    @property
    def base(self) -> DataFrame:
        """The cleaned log as Spark reads it, not staged."""
        return tables.plays_from_events(self.spark, self.sf_dir)

    @property
    def dirty(self) -> DataFrame:
        return tables.dirty_plays_from_events(self.spark, self.sf_dir)

    @property
    def plays(self) -> DataFrame:
        return self._once("plays", lambda: features.wide_plays(self.base))

    @property
    def sessions(self) -> DataFrame:
        """Plays with session ids."""
        return self._once(self._gap_name("sessions"), lambda: sessions.assign_sessions(self.plays, self.gap))

    @property
    def metrics(self) -> DataFrame:
        return self._once(self._gap_name("session_metrics"), lambda: sessions.session_metrics(self.sessions))

    @property
    def stats(self) -> DataFrame:
        return self._once(self._gap_name("session_stats"), lambda: sessions.session_stats(self.sessions))

    @property
    def scored(self) -> DataFrame:
        return sessions.session_score(self.stats)

    @property
    def features(self) -> DataFrame:
        return self._once(self._gap_name("features"), lambda: feature_table.build(self.base, self.gap))

    @property
    def log(self) -> OrderedLog:
        return OrderedLog(self._once("ordered_plays", lambda: order_log(self.plays).rows))

    @property
    def matrix(self) -> DataFrame:
        """The skip matrix with ``is_test``."""
        return self._once(self._gap_name("matrix"), lambda: split(skip_matrix(self.features)))

    @property
    def train(self) -> DataFrame:
        return self.matrix.where(~F.col("is_test")).drop("is_test")

    @property
    def test(self) -> DataFrame:
        return self.matrix.where("is_test").drop("is_test")
