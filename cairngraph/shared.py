"""Folders that the driver and all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir or, where that is unset, the context's checkpoint folder. Only a local
    master, which is one machine, may do with a folder of that machine."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    top = top or f"{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all tasks, where they come from fewer inputs than there are tasks."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if len(rows.inputFiles()) < tasks else rows
