"""Reading play logs: raw CSV, staged tables, and required-column checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.constants import RAW_COLUMNS
from earshot.sources.records import read_csv


class MissingColumns(ValueError):
    """The table lacks columns the pipeline needs."""


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


#: Names that exported logs use for a required column.
ALIASES = {"spotify_track_uri": "track_uri"}


def csv_options(line_breaks: bool = True) -> dict[str, str | bool]:
    """RFC 4180: quotes inside a quoted field are doubled."""
    return {"header": True, "quote": '"', "escape": '"', "multiLine": line_breaks, "enforceSchema": False}


def read_plays(spark: SparkSession, path: str, columns: Sequence[str] = RAW_COLUMNS, line_breaks: bool = True) -> DataFrame:
    """Raw log as text columns, found by the names in the header, whatever their order and whatever else there is.

    Typing is the cleaner's work, so no inference pass. Files of one folder must agree in their header; a missing
    column raises ``MissingColumns``. Large files are split either way; without ``line_breaks`` in quoted fields Spark's
    own reader does it in one pass, with them records are put together from lines in two.
    """
    names = spark.read.options(**csv_options()).csv(path).columns
    if line_breaks:
        raw = read_csv(spark, path, names)
    else:
        raw = spark.read.schema(text_schema(names)).options(**csv_options(False)).csv(path)
    named = raw.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in names and b not in names})
    return validate_schema(named, columns).select(*columns)


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A table written by an earlier step; CSV needs its schema because the text carries none."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError("reading a CSV stage needs a schema")
    as_text = read_plays(spark, path, schema.names)
    typed = [
        F.expr(f"try_to_timestamp(`{f.name}`)").alias(f.name)
        if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name).try_cast(f.dataType).alias(f.name)
        for f in schema
    ]
    return as_text.select(*typed)


def missing_columns(df: DataFrame, required: Sequence[str] = RAW_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def validate_schema(df: DataFrame, required: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df
