"""Session settings for a cluster or a test, and what a worker count means here."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold at any size; sizes themselves belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "pixeltide", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def workers(spark: SparkSession) -> int:
    """Tasks that run at the same time."""
    return spark.sparkContext.defaultParallelism


def capabilities(spark: SparkSession) -> dict[str, object]:
    """Version and the formats that this session reads and writes."""
    return {"spark": spark.version, "formats": ("parquet", "orc", "csv", "json"), "arrow": True}
