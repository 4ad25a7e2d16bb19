"""Duplicate records: exact and keyed groups, merging, conflicts, fuzzy pairs, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import split_list, title_key
from ..operators import entities, graph, merge
from ..registry import query
from ..sources.tables import PUB_SQL, publications, table


@query("dedup_exact", "SELECT text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, md5(text) AS text_hash FROM documents) GROUP BY text_hash HAVING count(*) > 1")
def dedup_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts: only digests are shuffled."""
    return table(spark, folder, "documents").select("doc_id", F.md5("text").alias("text_hash")).groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


@query("duplicate_rows", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


_ROWS = """WITH r AS (SELECT o_custkey AS merge_key, o_orderkey AS idx, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS priority,
  CASE WHEN o_orderkey % 4 = 0 THEN ' ' WHEN o_orderkey % 4 = 1 THEN 'n/a' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS venue, o_orderstatus || '; ' || o_orderpriority AS tags FROM orders)"""


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    priority = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    title = F.when(key % 4 == 0, " ").when(key % 4 == 1, "n/a").otherwise(F.col("o_orderpriority"))
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("merge_key"), key.alias("idx"), priority.alias("priority"), title.alias("title"), F.when(key % 3 != 0, F.col("o_orderstatus")).alias("venue"), F.concat("o_orderstatus", F.lit("; "), "o_orderpriority").alias("tags"))


@query("merge_group", _ROWS + """, t AS (SELECT merge_key, min_by(title, priority * 1000000000000 + idx) AS title FROM r WHERE trim(title) NOT IN ('', 'n/a') GROUP BY merge_key),
v AS (SELECT merge_key, min_by(venue, priority * 1000000000000 + idx) AS venue FROM r WHERE venue IS NOT NULL GROUP BY merge_key),
g AS (SELECT merge_key, count(*) AS group_size, count(DISTINCT tags) AS n_tags FROM r GROUP BY merge_key)
SELECT g.merge_key, t.title, v.venue, g.group_size FROM g LEFT JOIN t USING (merge_key) LEFT JOIN v USING (merge_key)""")
def merge_group(spark: SparkSession, folder: str) -> DataFrame:
    """Each group's first non-blank values by source priority, then row order."""
    merged = merge.merge_groups(_rows(spark, folder), "merge_key", [F.col("priority"), F.col("idx")], ["title", "venue"], ["tags"])
    return merged.select("merge_key", "title", "venue", "group_size")


@query("merged_tags", _ROWS + """, i AS (SELECT merge_key, priority, idx, unnest(string_split(tags, '; ')) AS tag, unnest([1, 2]) AS p FROM r),
f AS (SELECT merge_key, tag, min(priority * 1000000000000 + idx * 10 + p) AS place FROM i GROUP BY ALL)
SELECT merge_key, string_agg(tag, '; ' ORDER BY place) AS tags FROM f GROUP BY merge_key""")
def merged_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Each group's list items, in order of first mention."""
    return merge.merge_groups(_rows(spark, folder), "merge_key", [F.col("priority"), F.col("idx")], [], ["tags"]).select("merge_key", "tags")


@query("conflict_fields", _ROWS + """, c AS (SELECT merge_key, count(*) AS group_size, count(DISTINCT CASE WHEN trim(title) NOT IN ('', 'n/a') THEN lower(trim(title)) END) AS t, count(DISTINCT lower(venue)) AS v FROM r GROUP BY merge_key HAVING count(*) > 1)
SELECT merge_key, group_size, concat_ws(',', CASE WHEN t > 1 THEN 'title' END, CASE WHEN v > 1 THEN 'venue' END) AS conflict_fields FROM c""")
def conflict_fields(spark: SparkSession, folder: str) -> DataFrame:
    return merge.conflicts(_rows(spark, folder), "merge_key", ["title", "venue"])


@query("ownership_resolution", """WITH d AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'INCLUDE' WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'EXCLUDE' ELSE 'REVIEW' END AS decision FROM orders)
SELECT o_custkey, CASE WHEN bool_or(decision = 'INCLUDE') AND bool_or(decision = 'EXCLUDE') THEN 'REVIEW' WHEN bool_or(decision = 'INCLUDE') THEN 'INCLUDE' WHEN bool_or(decision = 'EXCLUDE') THEN 'EXCLUDE' ELSE 'REVIEW' END AS decision,
  bool_or(decision = 'INCLUDE') AND bool_or(decision = 'EXCLUDE') AS conflicting FROM d GROUP BY o_custkey""")
def ownership_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """A group's decision: contradicting ones go to review, an inclusion or exclusion wins over review."""
    decision = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), "INCLUDE").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 5 == 0), "EXCLUDE").otherwise("REVIEW")
    has = table(spark, folder, "orders").select("o_custkey", decision.alias("d")).groupBy("o_custkey").agg(F.bool_or(F.col("d") == "INCLUDE").alias("i"), F.bool_or(F.col("d") == "EXCLUDE").alias("e"))
    out = F.when(F.col("i") & F.col("e"), "REVIEW").when(F.col("i"), "INCLUDE").when(F.col("e"), "EXCLUDE").otherwise("REVIEW")
    return has.select("o_custkey", out.alias("decision"), (F.col("i") & F.col("e")).alias("conflicting"))


@query("missed_duplicates", PUB_SQL + """, k AS (SELECT publication_key, type, publication_year, string_split(authors, '; ')[1] AS first_author FROM pub WHERE coalesce(authors, '') <> '')
SELECT type, publication_year, first_author, count(*) AS n, min(publication_key) AS first_key FROM k GROUP BY ALL HAVING count(*) > 1""")
def missed_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups with one title key, year and first author, for review."""
    pub = publications(spark, folder, "publication_key", "type", "publication_year", "authors")
    rows = pub.select("publication_key", "type", "publication_year", F.try_element_at(split_list(F.col("authors")), F.lit(1)).alias("first_author")).where("first_author IS NOT NULL")
    return rows.groupBy("type", "publication_year", "first_author").agg(F.count("*").alias("n"), F.min("publication_key").alias("first_key")).where("n > 1")


@query("dedup_fuzzy")
def dedup_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one block (their first words) with titles, their first lines, of a similarity of 0.9 or more."""
    title = F.substring_index("text", "\n", 1)
    docs = table(spark, folder, "documents").select("doc_id", title.alias("title"), F.concat_ws(" ", F.slice(F.split(title_key(title), " "), 1, 2)).alias("block"))
    return entities.fuzzy_pairs(docs, "doc_id", "title", "block", 0.9)


@query("publication_groups", "SELECT min(doc_id) AS group_id, count(*) AS n FROM documents GROUP BY text")
def publication_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Leakage-safe groups: records that share any identity token are one group."""
    docs = table(spark, folder, "documents")
    tokens = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), F.concat(F.lit("t"), F.md5("text")).alias("target"), F.lit(1).alias("weight"))
    groups = graph.components(tokens).where(F.startswith("node", F.lit("d"))).select(F.substring("node", 2, 20).cast("long").alias("doc_id"), "component")
    return groups.groupBy("component").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).select("group_id", "n")


@query("author_clusters")
def author_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Author names resolved to people: by identifier, then by compatible names with shared co-authors."""
    pub = publications(spark, folder, "publication_key", "authors", "author_ids")
    return entities.author_clusters(pub)


@query("author_variants", PUB_SQL + """ SELECT label, count(DISTINCT publication_key) AS mentions, min(publication_year) AS first_year, max(publication_year) AS last_year FROM (SELECT publication_key, publication_year, trim(unnest(string_split(authors, ';'))) AS label FROM pub) WHERE label <> '' GROUP BY label""")
def author_variants(spark: SparkSession, folder: str) -> DataFrame:
    rows = publications(spark, folder, "publication_key", "publication_year", "authors").select("publication_key", "publication_year", F.explode(split_list(F.col("authors"))).alias("label"))
    return rows.groupBy("label").agg(F.countDistinct("publication_key").alias("mentions"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"))
