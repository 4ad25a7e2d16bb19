"""Review of records as a state machine over an event log: versions are compared and set, repeated requests change nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States and decisions of a review.
PENDING, ACCEPTED, REJECTED = "pending_review", "human_accepted", "human_rejected"
_LOG = "record {record}, seq {seq}, event string, decision string, actor string, outcome string, status string, version long, reviewer string, hard_negative boolean"


def _outcome(event, status: str | None, version: int, reviewer: str | None) -> str:
    """What becomes of an event, by the first rule that it breaks; ``applied`` if it breaks none."""
    if event.event not in ("decide", "reopen", "assign") or (event.event == "decide" and event.decision not in (ACCEPTED, REJECTED)):
        return "invalid"
    if event.event == "decide" and event.decision == REJECTED and not (event.notes or "").strip():
        return "reason_required"
    if status is None:
        return "not_found"
    if event.expected_version != version:
        return "stale"
    if event.event == "decide":
        if reviewer and (event.actor or "").lower() != reviewer.lower():
            return "forbidden"
        if status != PENDING:
            return "already_decided"
        if event.decision == ACCEPTED and not event.verified:
            return "ownership_not_verified"
    if event.event == "reopen" and status == PENDING:
        return "not_decided"
    return "applied"


def replay(records: DataFrame, events: DataFrame) -> DataFrame:
    """The log of all events with their outcome, and the state of the record after each one.

    ``records(record, verified, model_label)`` are pending at version 0. ``events(record, seq, key, event, decision,
    actor, notes, expected_version)`` are taken in the order of ``seq``: ``decide`` (accepted or rejected, which needs
    notes), ``reopen`` and ``assign`` (to ``actor``). One applies only if it expects the record's version, which it raises
    by one. A later event with the ``key`` of an earlier one of its record is ``repeated`` and changes nothing, whatever
    became of the first. Only the assigned reviewer decides; a record that is not verified cannot be accepted; rejecting
    what the model took for ``AI`` makes a hard negative. Sequence numbers are distinct; a null key never repeats.

    Events are dealt out by record and stream through the tasks in order, so that a record may have any number of them.
    """
    kinds = dict(events.dtypes)
    first = events.where("key IS NOT NULL").groupBy("record", "key").agg(F.min("seq").alias("first"))
    rows = events.join(first, ["record", "key"], "left").withColumn("again", F.coalesce(F.col("seq") > F.col("first"), F.lit(False))).drop("first")
    known = records.select("record", F.coalesce("verified", F.lit(False)).alias("verified"), "model_label", F.lit(True).alias("known"))
    rows = rows.join(known, "record", "left").repartition(F.col("record")).sortWithinPartitions("record", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, status, version, reviewer, hard = None, None, 0, None, False
        for pdf in batches:
            out = []
            text = pdf.astype(object).where(pdf.notna(), None)
            for e in text.itertuples(index=False):
                if e.record != at:
                    at, status, version, reviewer, hard = e.record, PENDING if e.known else None, 0, None, False
                outcome = "repeated" if e.again else _outcome(e, status, version, reviewer)
                if outcome == "applied":
                    version += 1
                    if e.event == "assign":
                        reviewer = e.actor
                    else:
                        status = PENDING if e.event == "reopen" else e.decision
                        hard = status == REJECTED and e.model_label == "AI"
                out.append((e.record, e.seq, e.event, e.decision, e.actor, outcome, status, version, reviewer, hard))
            yield pd.DataFrame(out, columns=["record", "seq", "event", "decision", "actor", "outcome", "status", "version", "reviewer", "hard_negative"])

    return rows.mapInPandas(run, _LOG.format(**kinds))


def states(records: DataFrame, log: DataFrame) -> DataFrame:
    """(record, status, version, reviewer, hard_negative, events, refused): where every record stands after a log."""
    last = F.max_by(F.struct("status", "version", "reviewer", "hard_negative"), "seq").alias("s")
    found = log.groupBy("record").agg(last, F.count_if(F.col("outcome") == "applied").alias("events"), F.count_if(~F.col("outcome").isin("applied", "repeated")).alias("refused"))
    rows = records.select("record").join(found, "record", "left")
    return rows.select(
        "record", F.coalesce("s.status", F.lit(PENDING)).alias("status"), F.coalesce("s.version", F.lit(0)).alias("version"), F.col("s.reviewer").alias("reviewer"),
        F.coalesce("s.hard_negative", F.lit(False)).alias("hard_negative"), F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("refused", F.lit(0)).alias("refused"),
    )
