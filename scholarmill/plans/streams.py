"""Incremental runs: checkpoints, upserts by batches, review states, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table
from ..streaming import incremental


@query("checkpoint_increment", "SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY event_type")
def checkpoint_increment(spark: SparkSession, folder: str) -> DataFrame:
    """What a run takes that starts the day after the last successful one."""
    start = incremental.start_date(None, "2024-01-14", "2024-01-01")
    return table(spark, folder, "events").where(F.col("ts") >= F.lit(start).cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("review_state", "SELECT user_id, max_by(event_type, event_id) AS state, max(event_id) AS version, count(*) AS changes FROM events GROUP BY user_id")
def review_state(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of every record in an append-only event log."""
    return incremental.latest(table(spark, folder, "events"), "user_id", "event_id", "event_type")


@query("review_stats", "WITH s AS (SELECT user_id, max_by(event_type, event_id) AS state FROM events GROUP BY user_id) SELECT state, count(*) AS n FROM s GROUP BY state")
def review_stats(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.latest(table(spark, folder, "events"), "user_id", "event_id", "event_type").groupBy("state").agg(F.count("*").alias("n"))


@query("event_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start_time, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Tumbling windows over events (an addition: the reference has no streams)."""
    return incremental.windows(table(spark, folder, "events"), "6 hours").select(F.col("window.start").alias("start_time"), "event_type", "n")


@query("stream_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start_time, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The same windows from a stream that takes all that is available, then stops."""
    return incremental.run_windows(spark, folder, "6 hours").select("start_time", "event_type", "n")


@query("sessions", "WITH e AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS events FROM s GROUP BY user_id")
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Visits: events of a user with gaps of twelve hours at most."""
    gaps = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "12 hours 1 microsecond")).agg(F.count("*").alias("n"))
    return gaps.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("reviewer_assignment", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 3 AS INTEGER) AS reviewer FROM labels WHERE quality = 0 ORDER BY doc_id LIMIT 300")
def reviewer_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """A page of pending records dealt to reviewers of equal load in turn."""
    page = table(spark, folder, "labels").where("quality = 0").select("doc_id").orderBy("doc_id").limit(300)
    return incremental.assign(page, "doc_id", 3)
