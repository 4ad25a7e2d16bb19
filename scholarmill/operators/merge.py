"""Merging of records: overlays, upserts, identifier matches, and groups of duplicates by priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distinct_caseless, nonblank, split_list


def overlay(rows: DataFrame, corrections: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the non-null corrected columns in place of their own."""
    right = corrections.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in columns))
    return rows.join(right, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*(f"_new_{c}" for c in columns))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, with stored values where theirs are null, and the stored rows without a new one."""
    columns = [c for c in stored.columns if c != key]
    a = stored.select(key, F.struct(*columns).alias("_a"))
    b = new.select(key, F.struct(*columns).alias("_b"))
    return a.join(b, key, "full").select(key, *(F.coalesce(f"_b.{c}", f"_a.{c}").alias(c) for c in columns))


def retire(stored: DataFrame, newest: DataFrame, key: str, exempt: Column) -> DataFrame:
    """``stored`` with ``retired``: not in the newest snapshot, and not exempt."""
    seen = newest.select(key).distinct().withColumn("_seen", F.lit(True))
    return stored.join(seen, key, "left").withColumn("retired", F.col("_seen").isNull() & ~F.coalesce(exempt, F.lit(False))).drop("_seen")


def match_any(new: DataFrame, old: DataFrame, new_key: str, old_key: str, ids: list[str]) -> DataFrame:
    """(new_key, old_key, matches, conflict): one equi-join for each identifier instead of a disjunctive join."""
    found = [new.select(new_key, i).where(F.col(i).isNotNull()).join(old.select(old_key, i), i).select(new_key, old_key) for i in ids]
    both = reduce(DataFrame.unionAll, found).distinct()
    return both.groupBy(new_key).agg(F.min(old_key).alias(old_key), F.count("*").alias("matches"), (F.count("*") > 1).alias("conflict"))


def match_best(hits: DataFrame, records: DataFrame, rank: str, key: str, ids: list[str]) -> DataFrame:
    """(rank, key): each hit's record by the first identifier that finds one, then the smallest key."""
    found = [
        hits.select(rank, F.col(i).alias("_id")).where("_id IS NOT NULL").join(records.select(F.col(i).alias("_id"), F.col(key).alias("_key")), "_id").select(rank, F.lit(p).alias("_p"), "_key")
        for p, i in enumerate(ids)
    ]
    return reduce(DataFrame.unionAll, found).groupBy(rank).agg(F.min(F.struct("_p", "_key"))["_key"].alias(key))


def registry_lookup(rows: DataFrame, key: str, column: str, registry: DataFrame) -> DataFrame:
    """(key, alias, institution_id, pos): the first comma part of a value that is an alias of the registry."""
    first = registry.groupBy("alias").agg(F.min("institution_id").alias("institution_id"))
    parts = rows.select(key, F.posexplode(F.split(F.lower(column), r"\s*,\s*")).alias("pos", "alias"))
    return parts.join(first, "alias").groupBy(key).agg(F.min(F.struct("pos", "alias", "institution_id")).alias("m")).select(key, "m.alias", "m.institution_id", "m.pos")


def merge_groups(rows: DataFrame, key: str, order: list[Column], single: list[str], many: list[str]) -> DataFrame:
    """One row for each key: the first non-blank value by ``order`` for single columns, ordered distinct items for lists."""
    place = F.struct(*order)
    aggs = [F.min_by(nonblank(F.col(c)), F.when(nonblank(F.col(c)).isNotNull(), place)).alias(c) for c in single]
    for c in many:
        gathered = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(c).alias("v")))), lambda x: split_list(x["v"]))
        aggs.append(F.array_join(distinct_caseless(F.flatten(gathered)), "; ").alias(c))
    return rows.groupBy(key).agg(*aggs, F.count("*").alias("group_size"))


def conflicts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, group_size, conflict_fields): the columns in which a group's non-blank values differ."""
    counted = rows.groupBy(key).agg(F.count("*").alias("group_size"), *(F.countDistinct(F.lower(nonblank(F.col(c)))).alias(f"_{c}") for c in columns)).where("group_size > 1")
    return counted.select(key, "group_size", F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_{c}") > 1, c) for c in columns))), ",").alias("conflict_fields"))


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
