"""Readers: stored tables, and the publications view that the analytic queries are written against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: What each multi-value column of a publication is gathered from.
_GATHERED = {"authors": "s_name", "author_ids": "l_suppkey", "institutions": "n_name", "countries": "r_name", "topics": "p_type"}
_NEEDS = {"s_name": {"supplier"}, "l_suppkey": set(), "n_name": {"supplier", "nation"}, "r_name": {"supplier", "nation", "region"}, "p_type": {"part"}}


def publications(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The publications view: one row for each order, with the columns asked for (all, where none are named).

    Only the tables that these columns come from are read. Multi-value columns are texts joined by ``; ``, as in the
    exchange format; ``split_list`` turns them into arrays. Blank and missing identifiers, counts and flags occur.
    """
    scalar = {
        "publication_key": F.concat(F.lit("source:openalex:"), F.col("o_orderkey").cast("string")),
        "publication_year": F.year("o_orderdate"),
        "publication_date": F.to_date("o_orderdate"),
        "title": F.concat(F.col("o_orderpriority"), F.lit(" study "), F.col("o_orderkey").cast("string")),
        "type": F.col("o_orderpriority"),
        "primary_field": F.col("c_mktsegment"),
        "is_oa": F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False),
        "citation_count": F.when(F.col("o_orderkey") % 17 != 0, F.floor(F.col("o_totalprice") / 1000).cast("long")),
        "doi": F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.concat(F.lit("10.1000/"), F.col("o_orderkey").cast("string"))),
        "source_dataset": F.when(F.col("o_orderkey") % 3 == 0, "openalex; crossref").when(F.col("o_orderkey") % 3 == 1, "repositories_combined").otherwise("openalex"),
    }
    wanted = list(columns) or [*scalar, *_GATHERED]
    out = table(spark, folder, "orders")
    if "primary_field" in wanted:
        out = out.join(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.select("o_orderkey", *(scalar[c].alias(c) for c in wanted if c in scalar))
    lists = [c for c in wanted if c in _GATHERED]
    if lists:
        needs = set().union(*(_NEEDS[_GATHERED[c]] for c in lists))
        lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        if "supplier" in needs:
            lines = lines.join(table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        if "nation" in needs:
            lines = lines.join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        if "region" in needs:
            lines = lines.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        if "part" in needs:
            lines = lines.join(table(spark, folder, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        lists_of = lines.groupBy("l_orderkey").agg(*(F.array_join(F.array_sort(F.collect_set(_GATHERED[c])), "; ").alias(c) for c in lists))
        out = out.join(lists_of, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select(*wanted)


#: The same view in DuckDB's SQL, to be continued with further WITH entries or a SELECT.
PUB_SQL = """
WITH lists AS (
  SELECT l_orderkey,
    array_to_string(list_sort(list(DISTINCT s_name)), '; ') AS authors,
    array_to_string(list_transform(list_sort(list(DISTINCT l_suppkey)), lambda x: CAST(x AS VARCHAR)), '; ') AS author_ids,
    array_to_string(list_sort(list(DISTINCT n_name)), '; ') AS institutions,
    array_to_string(list_sort(list(DISTINCT r_name)), '; ') AS countries,
    array_to_string(list_sort(list(DISTINCT p_type)), '; ') AS topics
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey),
pub AS (
  SELECT 'source:openalex:' || o_orderkey AS publication_key, CAST(year(o_orderdate) AS INTEGER) AS publication_year,
    CAST(o_orderdate AS DATE) AS publication_date, o_orderpriority || ' study ' || o_orderkey AS title,
    o_orderpriority AS type, c_mktsegment AS primary_field,
    CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS is_oa,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS citation_count,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '  ' ELSE '10.1000/' || o_orderkey END AS doi,
    CASE o_orderkey % 3 WHEN 0 THEN 'openalex; crossref' WHEN 1 THEN 'repositories_combined' ELSE 'openalex' END AS source_dataset,
    authors, author_ids, institutions, countries, topics
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lists ON o_orderkey = l_orderkey)
"""
