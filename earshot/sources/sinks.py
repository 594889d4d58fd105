"""Writing tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> str:
    """Event-sized table; ``partition_by`` (a date, say) lets later filters prune files."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if fmt == "csv":
        # text goes out as it is: the writer would trim it; quotes are doubled
        writer.options(
            timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path, header=True)
    else:
        writer.format(fmt).save(path)
    return path


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> str:
    """Report-sized result, written as one file. Its rows move to one task; the stage that makes them stays parallel."""
    return write_stage(df.repartition(1), path, fmt, mode=mode)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.repartition(1).write.mode(mode).json(path)
    return path
