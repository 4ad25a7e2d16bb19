"""A session with the settings the engine is meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "scholarmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC times, adaptive execution with skew handling; partitions are coalesced at run time unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
