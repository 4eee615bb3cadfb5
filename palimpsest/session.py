"""Session settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins and partition counts from what stages really wrote.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(app: str = "palimpsest", **more: str) -> SparkSession:
    """A session with SETTINGS; master and memory are left to spark-submit.

    more: further settings, with underscores for the dots of their names.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
