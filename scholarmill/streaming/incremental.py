"""Incremental processing: start dates, latest states, windowed streams, batch upserts."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.merge import upsert
from ..sources.work import shared_folder


def start_date(explicit: str | None, last_successful: str | None, initial: str) -> str:
    """Where a run starts: as told, or the day after the last successful one, or at the beginning."""
    if explicit:
        return explicit
    if last_successful:
        return (datetime.date.fromisoformat(last_successful) + datetime.timedelta(days=1)).isoformat()
    return initial


def latest(log: DataFrame, key: str, version: str, state: str) -> DataFrame:
    """(key, state, version, changes): the last entry of every key."""
    return log.groupBy(key).agg(F.max_by(state, version).alias("state"), F.max(version).alias("version"), F.count("*").alias("changes"))


def windows(events: DataFrame, size: str) -> DataFrame:
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def run_windows(spark: SparkSession, folder: str, size: str, late: str = "1 hour") -> DataFrame:
    """Counts of events in tumbling windows, from a stream over a folder's event table.

    The stream takes what is available and stops; each batch's complete result replaces the last one in the shared
    folder, so that a repeated batch changes nothing.
    """
    base = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = windows(stream, size).select(F.col("window.start").alias("start_time"), "event_type", "n")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    run = counted.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("start_time timestamp, event_type string, n long").parquet(f"{base}/out")


def upsert_batches(spark: SparkSession, stream: DataFrame, target: str, key: str, state: str) -> None:
    """Upserts every batch of a stream into a Parquet table; versions are kept apart, the newest one is current.

    A version is named by its batch: a batch that is run again writes the same version again.
    """

    def put(batch: DataFrame, number: int) -> None:
        old = f"{target}/version={number - 1}"
        stored = spark.read.parquet(old) if number else spark.createDataFrame([], batch.schema)
        newest = batch.groupBy(key).agg(*(F.last(c, ignorenulls=True).alias(c) for c in batch.columns if c != key))
        upsert(stored, newest, key).write.mode("overwrite").parquet(f"{target}/version={number}")

    run = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()


def assign(pending: DataFrame, key: str, reviewers: int) -> DataFrame:
    """Deals a page of pending records to reviewers of equal load in turn."""
    order = Window.partitionBy(F.lit(1)).orderBy(key)  # a page
    return pending.withColumn("reviewer", ((F.row_number().over(order) - 1) % reviewers).cast("int"))
