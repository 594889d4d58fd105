"""Staged tables: Parquet written once under the cluster's shared checkpoint folder.

A small side that is staged before a join is read back with its true size, so Spark
broadcasts it only under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges,
where adaptive execution can split a hot key (it cannot when an aggregate sits between the
exchange and the join). Staging also cuts lineage in a way that survives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="earshot-")
    return _local_roots[app]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def application_folder(spark: SparkSession) -> str:
    """Everything one application stages lies here."""
    return f"{staging_root(spark)}/earshot/{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Remove what this application staged; call it when no staged table is needed any more."""
    remove(spark, application_folder(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems; a missing one is no error."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return a reader of the written table, with other types of the same form if given."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def stage_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage independent tables as concurrent jobs, so that small ones do not wait for each other."""
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        jobs = {name: pool.submit(stage, df, name) for name, df in tables.items()}
    return {name: job.result() for name, job in jobs.items()}
