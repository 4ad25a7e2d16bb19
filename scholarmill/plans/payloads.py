"""References and works given as JSON texts, made flat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mapping, payloads
from ..registry import query
from ..sources.tables import table


def _references(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's parts as a list of JSON references between semicolons, with semicolons, quotes and brackets inside."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    doi = F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("https://doi.org/10.1000/P"), F.col("l_partkey").cast("string")))
    title = F.concat("p_name", F.lit('; "a \\ b" [{'), F.col("l_linenumber").cast("string"))
    item = F.to_json(F.struct(doi.alias("DOI"), F.when(F.col("l_partkey") % 2 == 0, title).alias("article-title"), title.alias("unstructured"), F.struct(F.col("p_brand").alias("name")).alias("author"), F.year("l_shipdate").alias("year")))
    listed = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", item.alias("item")))), lambda x: x["item"]), " ; ;").alias("references_json"))
    return listed.select("l_orderkey", F.concat(F.lit(" ; "), "references_json").alias("references_json"))


@query("reference_rows", """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS reference_index,
  CASE WHEN l_partkey % 3 <> 0 THEN '10.1000/p' || l_partkey END AS reference_doi, p_name || '; "a \\ b" [{' || l_linenumber AS reference_title, '{"name":"' || p_brand || '"}' AS reference_author, CAST(year(l_shipdate) AS VARCHAR) AS reference_year
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def reference_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each reference of a list of JSON texts."""
    return payloads.reference_rows(_references(spark, folder), "l_orderkey", "references_json").drop("raw_reference_json").withColumn("reference_index", F.col("reference_index").cast("long"))


def _works(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as the JSON of a work: suppliers are authors with institutions and countries, part types are topics."""
    who = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(who, F.col("l_suppkey") == F.col("s_suppkey"))
    country = F.when(F.col("n_nationkey") % 5 == 0, "lk").otherwise(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")))
    institutions = F.when(F.col("s_suppkey") % 4 != 0, F.array(F.struct(F.col("n_name").alias("display_name"), country.alias("country_code"))))
    author = F.struct("l_suppkey", F.struct(F.struct(F.col("s_name").alias("display_name")).alias("author"), (F.col("s_suppkey") % 7 == 0).alias("is_corresponding"), institutions.alias("institutions")).alias("a"))
    authors = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.array_distinct(F.collect_list(author))), lambda x: x["a"]).alias("authorships"))
    parts = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, folder, "part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    topics = parts.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_set(F.struct("p_type", "p_brand"))), lambda x: F.struct(x["p_type"].alias("display_name"), F.struct(x["p_brand"].alias("display_name")).alias("field"))).alias("topics"))
    orders = table(spark, folder, "orders").join(authors, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey").join(topics, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    work = F.struct(
        F.concat(F.lit("https://example.org/W"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("https://doi.org/10.1000/W"), F.col("o_orderkey").cast("string"))).alias("doi"), F.col("o_orderpriority").alias("display_name"),
        F.year("o_orderdate").alias("publication_year"), F.struct((F.col("o_orderstatus") == "F").alias("is_oa")).alias("open_access"), "authorships", "topics",
    )
    return orders.select("o_orderkey", F.to_json(work).alias("work"))


@query("works_flattened", """
WITH l AS (SELECT DISTINCT l_orderkey, s_suppkey, s_name, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'LK' ELSE 'C' || n_nationkey END AS country, s_suppkey % 4 <> 0 AS known FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
a AS (
  SELECT l_orderkey, count(*) AS author_count, string_agg(s_name, '; ' ORDER BY s_suppkey) AS authors, coalesce(string_agg(s_name, '; ' ORDER BY s_suppkey) FILTER (WHERE known AND country = 'LK'), '') AS home_authors,
    string_agg(CASE WHEN known THEN n_name ELSE '' END, '; ' ORDER BY s_suppkey) AS author_institutions, string_agg(CASE WHEN known THEN country ELSE '' END, '; ' ORDER BY s_suppkey) AS author_countries,
    arg_min(s_name, s_suppkey) AS first_author_name, arg_max(s_name, s_suppkey) AS last_author_name, coalesce(string_agg(s_name, '; ' ORDER BY s_suppkey) FILTER (WHERE s_suppkey % 7 = 0), '') AS corresponding_author_name,
    bool_or(known AND country = 'LK') AS has_home_author, bool_or(known AND country <> 'LK') AS has_foreign_author FROM l GROUP BY l_orderkey),
i AS (SELECT l_orderkey, string_agg(n_name, '; ' ORDER BY k) AS institutions FROM (SELECT l_orderkey, n_name, min(s_suppkey) AS k FROM l WHERE known GROUP BY ALL) GROUP BY l_orderkey),
c AS (SELECT l_orderkey, string_agg(country, '; ' ORDER BY k) AS countries FROM (SELECT l_orderkey, country, min(s_suppkey) AS k FROM l WHERE known GROUP BY ALL) GROUP BY l_orderkey),
t AS (SELECT l_orderkey, min((p_type, p_brand)) AS first_topic, list_sort(list(DISTINCT p_type)) AS ts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT o_orderkey, 'W' || o_orderkey AS work_id, CASE WHEN o_orderkey % 5 <> 0 THEN '10.1000/w' || o_orderkey END AS doi, o_orderpriority AS title, CAST(year(o_orderdate) AS INTEGER) AS publication_year, o_orderstatus = 'F' AS is_oa,
  CAST(coalesce(author_count, 0) AS INTEGER) AS author_count, coalesce(authors, '') AS authors, coalesce(home_authors, '') AS home_authors, coalesce(institutions, '') AS institutions, coalesce(countries, '') AS countries, coalesce(author_institutions, '') AS author_institutions, coalesce(author_countries, '') AS author_countries,
  first_author_name, last_author_name, coalesce(corresponding_author_name, '') AS corresponding_author_name, coalesce(has_home_author, FALSE) AS has_home_author, coalesce(has_foreign_author, FALSE) AS has_foreign_author, coalesce(array_to_string(ts, '; '), '') AS topics, ts[1] AS primary_topic, first_topic[2] AS primary_field
FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN i ON i.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey LEFT JOIN t ON t.l_orderkey = o_orderkey""")
def works_flattened(spark: SparkSession, folder: str) -> DataFrame:
    """Works given as JSON as rows of plain columns."""
    flat = payloads.flat_works(_works(spark, folder), "work")
    return flat.select(
        "o_orderkey", "work_id", "doi", "title", "publication_year", "is_oa", "author_count", "authors", "home_authors", "institutions", "countries", "author_institutions", "author_countries", "first_author_name", "last_author_name",
        "corresponding_author_name", "has_home_author", "has_foreign_author", "topics", "primary_topic", "primary_field",
    )


@query("repository_records", """
WITH r AS (SELECT o_orderkey, o_orderkey % 23 = 0 AS deleted, CAST(o_orderdate AS DATE) AS d, o_orderpriority, o_orderkey % 4 <> 0 AS known, o_orderkey % 3 AS k, l.subjects FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS subjects FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) l ON l_orderkey = o_orderkey)
SELECT o_orderkey AS source_record_id, deleted, CASE WHEN NOT deleted THEN o_orderpriority END AS title, CASE WHEN NOT deleted THEN coalesce(array_to_string(subjects, '|'), '') ELSE '' END AS keywords,
  CASE WHEN NOT deleted THEN CASE k WHEN 0 THEN CAST(d AS VARCHAR) WHEN 1 THEN CAST(year(d) AS VARCHAR) ELSE '2001-01-02T00:00:00Z' END END AS publication_date, CASE WHEN NOT deleted THEN CASE k WHEN 2 THEN 2001 ELSE CAST(year(d) AS INTEGER) END END AS publication_year,
  CASE WHEN known AND NOT deleted THEN '10.1000/R' || o_orderkey END AS doi, CASE WHEN NOT deleted THEN 'https://repo.example.org/' || o_orderkey END AS url FROM r""")
def repository_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as Dublin Core records of a repository, mapped to the common schema."""
    subjects = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("subject"))
    k, day = F.col("o_orderkey") % 3, F.to_date("o_orderdate").cast("string")
    stamp = F.lit("2001-01-02T00:00:00Z")
    dates = F.when(k == 0, F.array(stamp, day)).when(k == 1, F.array(F.year("o_orderdate").cast("string"), stamp)).otherwise(F.array(stamp))
    address = F.concat(F.lit("see https://repo.example.org/"), F.col("o_orderkey").cast("string"), F.lit("."))
    identifiers = F.when(F.col("o_orderkey") % 4 != 0, F.array(address, F.concat(F.lit("doi:10.1000/R"), F.col("o_orderkey").cast("string"), F.lit(")")))).otherwise(F.array(address))
    rows = table(spark, folder, "orders").join(subjects, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.select("o_orderkey", F.to_json(F.struct(F.array("o_orderpriority", F.lit("other")).alias("title"), "subject", dates.alias("date"), identifiers.alias("identifier"))).alias("metadata"), (F.col("o_orderkey") % 23 == 0).alias("deleted"))
    found = mapping.repository_records(rows, "oai_dc", "o_orderkey", "metadata", "deleted")
    return found.select("source_record_id", "deleted", "title", F.array_join("keywords", "|").alias("keywords"), "publication_date", "publication_year", "doi", "url")


@query("extracted_fields", """
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS journal, o_orderstatus AS container, CASE o_orderkey % 5 WHEN 0 THEN 'A; B ;' WHEN 1 THEN 'A|B' WHEN 2 THEN 'A, B, C, D' WHEN 3 THEN 'A, B' END AS authors, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y FROM orders)
SELECT k, coalesce(journal, container) AS journal_clean, CASE WHEN journal IS NULL THEN 'container' ELSE 'journal' END AS journal_source,
  CASE k % 5 WHEN 0 THEN 'A/B' WHEN 1 THEN 'A/B' WHEN 2 THEN 'A/B/C/D' WHEN 3 THEN 'A, B' ELSE '' END AS author_list, CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 1 END AS author_count_clean,
  CASE WHEN k % 7 = 0 THEN make_date(y, 1, 1) WHEN k % 2 = 0 THEN d ELSE CAST(date_trunc('month', d) AS DATE) END AS publication_date_clean, CASE WHEN k % 7 = 0 THEN 'publication_year_fallback' WHEN k % 2 = 0 THEN 'full' ELSE 'month' END AS publication_date_source FROM r""")
def extracted_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Journals, authors and dates of records by the precedence of columns."""
    k = F.col("o_orderkey")
    authors = F.when(k % 5 == 0, "A; B ;").when(k % 5 == 1, "A|B").when(k % 5 == 2, "A, B, C, D").when(k % 5 == 3, "A, B")
    known = k % 7 != 0
    rows = table(spark, folder, "orders").select(
        k.alias("k"), F.when(k % 3 != 0, F.col("o_orderpriority")).otherwise(F.lit(" ")).alias("journal"), F.col("o_orderstatus").alias("container"), authors.alias("author_names"), F.lit("").alias("authors"),
        F.when(known & (k % 2 == 0), F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("n/a").alias("full"), F.when(known, F.date_format("o_orderdate", "yyyy-MM")).alias("month"), F.year("o_orderdate").cast("string").alias("year"),
    )
    found = mapping.extracted(rows, {"journal": ["journal", "container"], "authors": ["author_names", "authors"]}, ["full", "month"], "year")
    return found.select("k", "journal_clean", "journal_source", F.array_join("author_list", "/").alias("author_list"), "author_count_clean", "publication_date_clean", "publication_date_source")


@query("funder_identifiers", """
WITH i AS (SELECT l_orderkey, l_suppkey, l_partkey % 3 AS k, min(l_linenumber) AS place FROM lineitem GROUP BY ALL),
x AS (SELECT l_orderkey, CASE k WHEN 0 THEN 'F' || l_suppkey WHEN 1 THEN 'https://ror.org/' || l_suppkey ELSE 'plain ' || l_suppkey END AS v, place FROM i)
SELECT l_orderkey, string_agg(v, '; ' ORDER BY place, v) AS funder_identifier FROM (SELECT l_orderkey, v, min(place) AS place FROM x GROUP BY ALL) GROUP BY l_orderkey""")
def funder_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of funders from objects, nested lists and plain texts."""
    n = F.col("l_suppkey").cast("string")
    k = F.col("l_partkey") % 3
    text = F.when(k == 0, F.to_json(F.struct(F.concat(F.lit("F"), n).alias("id"), F.lit("x").alias("name")))).when(k == 1, F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("https://ror.org/"), n).alias("id"))).alias("ids")))).otherwise(F.concat(F.lit(" plain  "), n))
    value = F.when(k == 0, F.concat(F.lit("F"), n)).when(k == 1, F.concat(F.lit("https://ror.org/"), n)).otherwise(F.concat(F.lit("plain "), n))
    items = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), value.alias("v"), text.alias("t"))
    rows = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "v", "t"))), lambda x: x["t"]), "; ").alias("funder_id"))
    return mapping.funder_identifiers(rows, "l_orderkey", "funder_id")
