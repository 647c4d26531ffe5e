"""Tables in the folder that the driver and all executors share, and over all their cores."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Where the setting is absent and Spark runs on this machine alone, as in tests, a
    temporary folder becomes the checkpoint folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        base = context.getCheckpointDir()
    elif not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later plans start from the files."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that stored() gave, once nothing reads it any more."""
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        system, path = pfs.FileSystem.from_uri(folder)
        system.delete_dir(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where their files give fewer splits than that, before work that is heavy per row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
