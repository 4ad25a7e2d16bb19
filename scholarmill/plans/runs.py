"""Incremental runs with failures, and reviews replayed from an event log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table
from ..sources.work import shared_folder
from ..streaming import reviews, runs


@query("incremental_runs", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY user_id")
def incremental_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every user's latest event after three runs over days of events, the second of which fails once and goes on."""
    made = runs.Runs(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}", "events", "2024-01-01")
    failures = iter([True])

    def fetch(run_id: str, window: runs.Window) -> DataFrame:
        day = F.to_date("ts")
        return table(spark, folder, "events").where(day.between(F.lit(window.from_date).cast("date"), F.lit(window.to_date).cast("date")))

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))

    def unsteady(rows: DataFrame) -> DataFrame:
        if made.checkpoint() and next(failures, False):
            raise ConnectionError("the service is not there")
        return rows

    for to_date in ("2024-01-10", "2024-01-20", "2024-01-20", "2024-01-24"):
        try:
            made.run(to_date, fetch, [("latest", latest), ("unsteady", unsteady)], "user_id")
        except ConnectionError:
            continue
    return made.table().select("user_id", "event_id", "event_type")


def _reviewed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events as requests to review users: the type gives the decision, ids some reviewers, versions and repeated keys."""
    events = table(spark, folder, "events")
    k = F.col("event_id")
    event = F.when(k % 13 == 0, "assign").when(k % 7 == 0, "reopen").when(k % 101 == 0, "approve").otherwise("decide")
    decision = F.when(F.col("event_type").isin("view", "click"), reviews.ACCEPTED).otherwise(reviews.REJECTED)
    requests = events.select(
        F.col("user_id").alias("record"), k.alias("seq"), F.when(k % 5 == 0, F.concat_ws(":", F.col("event_type"), (k % 3).cast("string"))).alias("key"), event.alias("event"), decision.alias("decision"),
        F.concat(F.lit("r"), (k % 2).cast("string")).alias("actor"), F.when(k % 4 != 0, "not in scope").alias("notes"), F.when(F.col("value") < 40, 0).when(F.col("value") < 70, 1).otherwise(2).cast("long").alias("expected_version"),
    )
    records = events.where("user_id % 19 <> 0").select(F.col("user_id").alias("record"), (F.col("user_id") % 3 != 0).alias("verified"), F.when(F.col("user_id") % 2 == 0, "AI").otherwise("NON_AI").alias("model_label")).distinct()
    return records, requests


_REVIEW_SQL = """WITH RECURSIVE q AS (
  SELECT user_id AS record, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN event_type || ':' || event_id % 3 END AS key, CASE WHEN event_id % 13 = 0 THEN 'assign' WHEN event_id % 7 = 0 THEN 'reopen' WHEN event_id % 101 = 0 THEN 'approve' ELSE 'decide' END AS event,
    CASE WHEN event_type IN ('view', 'click') THEN 'human_accepted' ELSE 'human_rejected' END AS decision, 'r' || event_id % 2 AS actor, event_id % 4 <> 0 AS noted, CASE WHEN value < 40 THEN 0 WHEN value < 70 THEN 1 ELSE 2 END AS expected,
    user_id % 19 <> 0 AS known, user_id % 3 <> 0 AS verified, user_id % 2 = 0 AS ai FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY seq) AS k, key IS NOT NULL AND row_number() OVER (PARTITION BY record, key ORDER BY seq) > 1 AS again FROM q),
s AS (
  SELECT DISTINCT record, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, '' AS outcome, CASE WHEN known THEN 'pending_review' END AS status, CAST(0 AS BIGINT) AS version, CAST(NULL AS VARCHAR) AS reviewer, FALSE AS hard FROM e
  UNION ALL
  SELECT record, k, seq, o, CASE WHEN o <> 'applied' OR event = 'assign' THEN status WHEN event = 'reopen' THEN 'pending_review' ELSE decision END, version + CASE WHEN o = 'applied' THEN 1 ELSE 0 END,
    CASE WHEN o = 'applied' AND event = 'assign' THEN actor ELSE reviewer END, CASE WHEN o <> 'applied' OR event = 'assign' THEN hard ELSE event = 'decide' AND decision = 'human_rejected' AND ai END
  FROM (
    SELECT e.record, e.k, e.seq, e.event, e.decision, e.actor, e.ai, s.status, s.version, s.reviewer, s.hard,
      CASE WHEN again THEN 'repeated' WHEN event = 'approve' THEN 'invalid' WHEN event = 'decide' AND decision = 'human_rejected' AND NOT noted THEN 'reason_required' WHEN NOT known THEN 'not_found' WHEN expected <> version THEN 'stale'
        WHEN event = 'decide' AND reviewer IS NOT NULL AND reviewer <> actor THEN 'forbidden' WHEN event = 'decide' AND status <> 'pending_review' THEN 'already_decided' WHEN event = 'decide' AND decision = 'human_accepted' AND NOT verified THEN 'ownership_not_verified'
        WHEN event = 'reopen' AND status = 'pending_review' THEN 'not_decided' ELSE 'applied' END AS o
    FROM s JOIN e ON e.record = s.record AND e.k = s.k + 1))
"""


@query("review_outcomes", _REVIEW_SQL + "SELECT record, seq, outcome, status, version, reviewer, hard AS hard_negative FROM s WHERE k > 0")
def review_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every request, and the record's state after it."""
    return reviews.replay(*_reviewed(spark, folder)).select("record", "seq", "outcome", "status", "version", "reviewer", "hard_negative")


@query("review_records", _REVIEW_SQL + """, z AS (SELECT record, max_by(status, k) AS status, max_by(version, k) AS version, max_by(coalesce(reviewer, ''), k) AS reviewer, max_by(hard, k) AS hard_negative, count(*) FILTER (WHERE outcome = 'applied') AS events, count(*) FILTER (WHERE k > 0 AND outcome NOT IN ('applied', 'repeated')) AS refused FROM s GROUP BY record)
SELECT record, status, version, nullif(reviewer, '') AS reviewer, hard_negative, events, refused FROM z WHERE record % 19 <> 0""")
def review_records(spark: SparkSession, folder: str) -> DataFrame:
    """Where every record stands after all requests."""
    records, requests = _reviewed(spark, folder)
    return reviews.states(records, reviews.replay(records, requests))
