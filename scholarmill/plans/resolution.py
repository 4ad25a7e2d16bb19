"""Duplicates with every threshold, people under constraints, splits without leaks, groups that merging missed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import title_key
from ..operators import duplicates, graph, missed, people, splits
from ..registry import query
from ..sources.tables import table
from ..sources.work import written

_GRID = [90.0, 92.0, 95.0, 97.0, 99.0]


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as records: the first line is the title, equal texts have one DOI, which every third record lacks."""
    title = F.substring_index("text", "\n", 1)
    doi = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("10.1000/"), F.md5("text")))
    return table(spark, folder, "documents").select("doc_id", title.alias("title"), F.concat_ws(" ", "source", "lang").alias("authors"), (2016 + F.col("doc_id") % 2).alias("publication_year"), doi.alias("doi"), F.col("lang").alias("journal"), "source", F.md5("text").alias("digest"))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.features(_records(spark, folder), "doc_id", "title", "authors", "publication_year", "doi", ["title", "authors", "journal", "doi"])


@query("fuzzy_matches")
def fuzzy_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs of records with what the table of DOIs decides."""
    return duplicates.fuzzy_matches(_features(spark, folder), 90.0)


@query("duplicate_thresholds")
def duplicate_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and quality at every threshold of a grid, against copies of a text (1) and other records of a first line's block (0)."""
    found = _features(spark, folder)
    matches = written(duplicates.fuzzy_matches(found, min(_GRID)), "matches")
    forest = graph.spanning_forest(matches.select("a", "b", "weight"))
    groups = written(duplicates.groups_at(found, forest, _GRID), "threshold-groups")
    digest = _records(spark, folder).select(F.col("doc_id").alias("id"), "digest")
    rows = found.join(digest, "id")
    lead = lambda key, label: rows.groupBy(key).agg(F.min("id").alias("a")).join(rows, key).where("a <> id").select("a", F.col("id").alias("b"), F.lit(label).alias("label"))
    truth = lead("digest", 1).unionAll(lead("block", 0)).groupBy("a", "b").agg(F.max("label").alias("label"))
    return duplicates.sweep(matches, groups, truth, _GRID)


@query("duplicate_representatives")
def duplicate_representatives(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's group at a threshold of 92, and whether it stays."""
    found = _features(spark, folder)
    forest = graph.spanning_forest(duplicates.fuzzy_matches(found, 92.0).select("a", "b", "weight"))
    return duplicates.representatives(found, duplicates.groups_at(found, forest, [92.0])).withColumnRenamed("id", "doc_id")


_FIRST_NAMES = ["Kumara", "K.", "Kamal", "Nimal", "N. P.", "Nimal Prasad", "Ruwan", "R.", "Ruwani", "S. K.", "Sunil Kamal", "Sarath", "A."]


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Authors of orders: a given name by the supplier's key, the nation as surname, some identifiers and institutions."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    who = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    given = F.get(F.array(*(F.lit(n) for n in _FIRST_NAMES)), F.pmod("s_suppkey", F.lit(len(_FIRST_NAMES))).cast("int"))
    name = F.concat(F.regexp_replace("n_name", "[^A-Za-z]", ""), F.element_at(F.split("n_name", "_"), -1), F.lit(", "), given)
    who = who.select("s_suppkey", name.alias("name"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("0000-"), F.col("s_suppkey").cast("string"))).alias("orcid"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("inst "), (F.col("s_suppkey") % 17).cast("string"))).alias("institution"))
    return lines.join(who, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("record"), "name", "orcid", "institution")


@query("author_people")
def author_people(spark: SparkSession, folder: str) -> DataFrame:
    """Names resolved to people, with a reviewer's verdict against one pair of names of each surname."""
    mentions = _mentions(spark, folder)
    surname = F.lower(F.regexp_replace("name", ",.*", ""))
    verdicts = mentions.select(F.lit("different_author").alias("decision"), F.concat(surname, F.lit("|kumara")).alias("a"), F.concat(surname, F.lit("|k")).alias("b")).distinct()
    return people.disambiguate(mentions, verdicts, shared=2).authors


_TITLE_SQL = r"nullif(trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{M}\p{N}\x{200c}\x{200d}]+', ' ', 'g')), '')"


@query("missed_duplicate_groups", f"""
WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN '10.1000/' || md5(text) END AS doi, {_TITLE_SQL} AS title, 2016 + doc_id % 2 AS year, CASE WHEN doc_id % 4 <> 0 THEN source END AS author, source FROM documents),
f AS (
  SELECT 0 AS place, 'duplicate_doi_after_dedup' AS method, 'high' AS confidence, doi AS key, r.* FROM r WHERE doi IS NOT NULL
  UNION ALL SELECT 1, 'title_year_first_author', 'medium', title || '|' || year || '|' || author, r.* FROM r WHERE title IS NOT NULL AND author IS NOT NULL
  UNION ALL SELECT 2, 'title_year', 'low', title || '|' || year, r.* FROM r WHERE title IS NOT NULL AND author IS NULL
  UNION ALL SELECT 3, 'title_first_author_near_year', 'low', title || '|' || author, r.* FROM r WHERE title IS NOT NULL AND author IS NOT NULL),
g AS (
  SELECT place, method, confidence, key, list_sort(list(id)) AS ids, count(*) AS n, min(id) AS first_id,
    CASE WHEN count(doi) = 0 THEN 'all_missing' WHEN count(doi) < count(*) THEN 'some_missing' WHEN count(DISTINCT doi) = 1 THEN 'same_doi' ELSE 'different_doi' END AS doi_state,
    coalesce(string_agg(DISTINCT doi, '; ' ORDER BY doi), '') AS dois, string_agg(DISTINCT CAST(year AS VARCHAR), '; ' ORDER BY CAST(year AS VARCHAR)) AS years, max(year) - min(year) AS year_span, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources
  FROM f GROUP BY place, method, confidence, key HAVING count(*) > 1 AND (place < 3 OR max(year) - min(year) = 1))
SELECT method, confidence, key, n, first_id, doi_state, dois, years, year_span, sources FROM g QUALIFY row_number() OVER (PARTITION BY ids ORDER BY place, key) = 1""")
def missed_duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that merging may have missed, by four ways; each set of records under the first way that finds it."""
    rows = _records(spark, folder)
    title = F.nullif(title_key(F.col("title")), F.lit(""))
    author = F.when(F.col("doc_id") % 4 != 0, F.col("source"))
    return missed.missed_duplicates(rows.select(F.col("doc_id").alias("id"), "doi", title.alias("title"), F.col("publication_year").alias("year"), author.alias("author"), "source"))


_URL, _MAIL = r"https?://[^\s<>]+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("leakage_safe_split", f"""
WITH RECURSIVE r AS (
  SELECT doc_id, lang, {_TITLE_SQL} AS title, md5(text) AS digest, nullif(regexp_replace(regexp_replace(lower(regexp_extract(text, '{_URL}')), '^https?://(www\\.)?', ''), '/+$', ''), '') AS url, nullif(lower(regexp_extract(text, '{_MAIL}')), '') AS mail FROM documents),
t AS (
  SELECT doc_id, 'd' || digest AS token FROM r UNION SELECT doc_id, 'u' || url FROM r WHERE url IS NOT NULL UNION SELECT doc_id, 'm' || mail FROM r WHERE mail IS NOT NULL
  UNION SELECT doc_id, 't' || title FROM r WHERE length(title) >= 20),
o AS (SELECT token, min(doc_id) AS a FROM t GROUP BY token),
e AS (SELECT DISTINCT o.a, t.doc_id AS b FROM t JOIN o USING (token) WHERE o.a <> t.doc_id),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT doc_id AS root, doc_id AS node FROM r UNION SELECT w.root, x.b FROM walk w JOIN both_ways x ON x.a = w.node),
g AS (SELECT node AS doc_id, min(root) AS group_id FROM walk GROUP BY node),
c AS (SELECT group_id, lang, count(*) AS n FROM r JOIN g USING (doc_id) GROUP BY ALL),
s AS (SELECT group_id, min_by(lang, (-n, lang)) AS stratum FROM c GROUP BY group_id),
p AS (SELECT group_id, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || group_id), group_id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS total FROM s)
SELECT doc_id, lang, group_id, CASE WHEN k < round(total * 0.8 + 1e-9) THEN 'train' WHEN k < round(total * 0.9 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM r JOIN g USING (doc_id) JOIN p USING (group_id)""")
def leakage_safe_split(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in three parts, stratified by language: what shares a text, title, address or mail stays together."""
    docs = table(spark, folder, "documents")
    found = lambda pattern: F.regexp_extract("text", pattern, 0)
    tokens = splits.identity_tokens(identifiers={"text": F.md5("text"), "mail": found(_MAIL)}, urls={"url": found(_URL)}, title=F.substring_index("text", "\n", 1))
    rows = docs.select("doc_id", "lang", tokens.alias("tokens"))
    return splits.stratified_split(rows, "doc_id", "lang", "tokens", (0.8, 0.1, 0.1), seed=7).select("doc_id", "lang", "group_id", "split")
