"""The folder that driver and executors share, as the session names it."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Collections of garbage, and seconds after each, until the files of a finished pass are gone.
COLLECTIONS, PAUSE = 4, 0.5


def _root(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where none is named and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="shared-")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of ``folder`` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ensure_checkpoints(df: DataFrame) -> None:
    """Points checkpoints to the shared folder, unless the session has a checkpoint folder already."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_root(df.sparkSession))


def free_shuffles(spark: SparkSession) -> None:
    """Lets the session delete files of shuffles that no table refers to any more.

    It does so after a collection of garbage.  What Python let go of reaches the JVM a
    moment later, and a plan goes before its shuffles do, so one collection is too early.
    """
    for _ in range(COLLECTIONS):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(PAUSE)
