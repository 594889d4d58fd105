"""Staged tables of one operator run, removed as soon as they are not needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from earshot.sources import staging


class Scratch:
    """Writes tables below the shared folder that ``spark.checkpoint.dir`` names, and removes them again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[tuple[DataFrame, str]] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = staging.stage_path(self.spark, name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((back, path))
        return back

    def stage_observed(self, df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, tuple]:
        """The table, and measures of all its rows that are taken while it is written."""
        seen = Observation()
        table = self.stage(df.observe(seen, *measures), name)
        return table, tuple(seen.get.values())

    def drop(self, *tables: DataFrame) -> None:
        """Tables of others are left alone."""
        for table in tables:
            for entry in [x for x in self._paths if x[0] is table]:
                self._paths.remove(entry)
                staging.remove(self.spark, entry[1])


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in docs.columns} or name in out:
            name = "_" + name
        out.append(name)
    return out
