"""URL filters by a temporal list join: every capture is judged by the list entries active when it was fetched.

Dated entries (added, removed) become validity intervals. A capture is looked up under its host and each parent
domain, as of the fetch time. Only narrow columns move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def host_of(url):
    """Lower-case host of a URL, without user, port and a leading ``www.``; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def domains_of(host):
    """A host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).when(n < 3, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) from dated entries (list, key, action, ts); ``until`` is null while an entry stands.

    An addition holds until the next removal of the same key from the same list. Repeated additions and removals
    change nothing; of both at one time the removal counts. Other actions and rows with nulls are left out.
    """
    clean = entries.where(F.col("action").isin("add", "remove") & F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("ts").isNotNull())
    dated = clean.groupBy("list", F.lower("key").alias("key"), "ts").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "key").orderBy("ts")
    turns = dated.withColumn("was", F.lag("action").over(order)).where("(action = 'add' AND coalesce(was, 'remove') = 'remove') OR (action = 'remove' AND was = 'add')")
    spans = turns.withColumn("until", F.lead("ts").over(order)).where("action = 'add'")
    return spans.select("list", "key", F.col("ts").alias("since"), "until")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(page_id, host, n_entries, lists, allowed) for every capture.

    ``n_entries`` counts the active entries that name the host or a parent domain, ``lists`` joins the names of their
    lists, sorted, by commas; a capture without any is allowed. A capture without a host or a time matches nothing.
    A capture that comes again, with its host and time, comes out once; one with several hosts or times has a row for
    each. Captures with a null id are left out. Other columns are ignored; empty tables are no special case.

    The join is as of the fetch time: captures stand in one timeline with the changes of each list that names their key,
    and take the last change before them. Timelines are cut into months, each of which begins with what was active
    before, so that a busy key is many groups; a capture meets as many rows as lists name its key, not their intervals.
    """
    intervals = materialise(validity_intervals(entries), "url-intervals")
    seen = captures.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).cast("timestamp").alias("at")).distinct()
    looked = seen.where("at IS NOT NULL").select("page_id", "host", "at", F.explode(domains_of(F.col("host"))).alias("key"), F.date_trunc("month", "at").alias("month"))
    wanted = materialise(looked.select("key", "month").distinct(), "url-months")
    turn = lambda ts, rank, on: ("key", "list", F.date_trunc("month", ts).alias("month"), F.col(ts).alias("ts"), F.lit(rank).alias("rank"), F.lit(on).alias("active"))
    turns = intervals.select(*turn("since", 1, True)).unionAll(intervals.where("until IS NOT NULL").select(*turn("until", 1, False))).join(wanted, ["key", "month"], "left_semi")
    before = intervals.join(wanted, "key").where("since < month AND (until IS NULL OR until >= month)").select(*turn("month", 0, True))
    marks = materialise(turns.select("key", "list", "month", "ts", "rank", "active").unionAll(before), "url-marks")
    asked = looked.join(marks.select("key", "month", "list").distinct(), ["key", "month"])
    line = marks.select("key", "list", "month", "ts", "rank", "active", *(F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("host", "string"))))
    line = line.unionAll(asked.select("key", "list", "month", F.col("at").alias("ts"), F.lit(2).alias("rank"), F.lit(None).cast("boolean").alias("active"), "page_id", "host"))
    so_far = Window.partitionBy("key", "list", "month").orderBy("ts", "rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = line.withColumn("active", F.last("active", ignorenulls=True).over(so_far)).where("rank = 2 AND active")
    verdict = hit.groupBy("page_id", "host", F.col("ts").alias("at")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = seen.join(verdict, ["page_id", "host", "at"], "left")
    return out.select("page_id", "host", F.coalesce("n", F.lit(0).cast("long")).alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n").isNull().alias("allowed"))
