"""Cleaning stages: identifiers, dates, languages, lists, search text, counts of two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.names import html_titles, parsed_names
from ..functions.payloads import inverted_index, text_of_index
from ..registry import query
from ..sources.tables import PUB_SQL, publications, table

_DIRTY = """WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://doi.org/10.1234/AbC.' || doc_id || '.' WHEN 1 THEN 'doi:10.5555/x' || doc_id || ')' WHEN 2 THEN ' 10.77/bad ' WHEN 3 THEN '' WHEN 4 THEN 'see http://dx.doi.org/10.9999/q' || doc_id END AS raw FROM documents)"""


def _dirty(spark: SparkSession, folder: str) -> DataFrame:
    i, d = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    raw = F.when(d == 0, F.concat(F.lit("https://doi.org/10.1234/AbC."), i, F.lit("."))).when(d == 1, F.concat(F.lit("doi:10.5555/x"), i, F.lit(")"))).when(d == 2, " 10.77/bad ").when(d == 3, "").when(d == 4, F.concat(F.lit("see http://dx.doi.org/10.9999/q"), i))
    return table(spark, folder, "documents").select("doc_id", raw.alias("raw"))


@query("doi_normalised", _DIRTY + """, p AS (SELECT doc_id, raw, regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^(https?://(dx\\.)?doi\\.org/|doi:)', ''), '\\s+', '', 'g'), '[.,;:)\\]}]+$', '') AS plain FROM d)
SELECT doc_id, nullif(plain, '') AS plain, nullif(regexp_replace(regexp_extract(lower(raw), '(10\\.\\d{4,9}/[^\\s"''<>]+)', 1), '[.,;:)\\]}]+$', ''), '') AS strict,
  coalesce(regexp_full_match(plain, '10\\.\\d{4,9}/[^\\s"''<>]+'), FALSE) AS valid FROM p""")
def doi_normalised(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.col("raw")
    return _dirty(spark, folder).select("doc_id", C.doi_plain(raw).alias("plain"), C.doi_strict(raw).alias("strict"), C.is_doi(raw).alias("valid"))


@query("valid_doi_rows", _DIRTY + " SELECT count(*) AS n FROM d WHERE regexp_full_match(regexp_replace(regexp_replace(lower(trim(raw)), '^(https?://(dx\\.)?doi\\.org/|doi:)', ''), '[.,;:)\\]}]+$', ''), '10\\.\\d{4,9}/[^\\s\"''<>]+')")
def valid_doi_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _dirty(spark, folder).where(C.is_doi(F.col("raw"))).agg(F.count("*").alias("n"))


@query("language_normalised", """WITH d AS (SELECT CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN upper(lang) || '-XX' WHEN doc_id % 5 = 0 AND lang = 'en' THEN 'English' ELSE lang END AS raw FROM documents)
SELECT raw, CASE WHEN trim(raw) = '' THEN 'unknown' WHEN lower(trim(raw)) = 'english' THEN 'en' ELSE string_split(replace(lower(trim(raw)), '-', '_'), '_')[1] END AS language, count(*) AS n FROM d GROUP BY ALL""")
def language_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Raw and normalised codes with their counts."""
    raw = F.when(F.col("doc_id") % 11 == 0, " ").when(F.col("doc_id") % 7 == 0, F.concat(F.upper("lang"), F.lit("-XX"))).when((F.col("doc_id") % 5 == 0) & (F.col("lang") == "en"), "English").otherwise(F.col("lang"))
    return table(spark, folder, "documents").select(raw.alias("raw")).groupBy("raw", C.language_code(F.col("raw")).alias("language")).agg(F.count("*").alias("n"))


@query("year_filter", PUB_SQL + """, y AS (SELECT publication_key, coalesce(CASE WHEN publication_year % 2 = 0 THEN publication_year END, TRY_CAST(regexp_extract(CAST(publication_date AS VARCHAR), '(1[5-9]\\d\\d|20\\d\\d)', 1) AS INTEGER)) AS year FROM pub)
SELECT publication_key, year FROM y WHERE year BETWEEN 1997 AND 2000""")
def year_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The first year found over several columns, within the covered range."""
    year = F.coalesce(F.when(F.col("publication_year") % 2 == 0, F.col("publication_year")), C.year_in(F.col("publication_date")))
    return publications(spark, folder, "publication_key", "publication_year", "publication_date").select("publication_key", year.alias("year")).where(F.col("year").between(1997, 2000))


@query("year_filter_counts", PUB_SQL + " SELECT count(*) FILTER (WHERE publication_year BETWEEN 1997 AND 2000) AS kept, count(*) FILTER (WHERE publication_year < 1997) AS before_range, count(*) FILTER (WHERE publication_year > 2000) AS after_range, count(*) FILTER (WHERE publication_year IS NULL) AS missing FROM pub")
def year_filter_counts(spark: SparkSession, folder: str) -> DataFrame:
    y = F.col("publication_year")
    return publications(spark, folder, "publication_year").agg(F.count_if(y.between(1997, 2000)).alias("kept"), F.count_if(y < 1997).alias("before_range"), F.count_if(y > 2000).alias("after_range"), F.count_if(y.isNull()).alias("missing"))


@query("partial_dates", """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y') || '-13-01' WHEN 4 THEN strftime(o_orderdate, '%Y-%m') || '-32' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS raw,
  strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS ym, strftime(o_orderdate, '%Y-%m-%d') AS ymd, strftime(o_orderdate, '%Y-%d-%m') AS ydm, day(o_orderdate) AS dd FROM orders)
SELECT o_orderkey, raw, CASE o_orderkey % 6 WHEN 0 THEN ymd WHEN 1 THEN ym WHEN 2 THEN y WHEN 3 THEN y WHEN 4 THEN ym ELSE CASE WHEN dd > 12 THEN ymd ELSE ydm END END AS clean FROM d""")
def partial_dates(spark: SparkSession, folder: str) -> DataFrame:
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy-MM")).when(k == 2, F.date_format(at, "yyyy")).when(k == 3, F.concat(F.date_format(at, "yyyy"), F.lit("-13-01"))).when(k == 4, F.concat(F.date_format(at, "yyyy-MM"), F.lit("-32"))).otherwise(F.date_format(at, "dd/MM/yyyy"))
    return table(spark, folder, "orders").select("o_orderkey", raw.alias("raw")).withColumn("clean", C.partial_date(F.col("raw")))


@query("multivalue_items", PUB_SQL + """, i AS (SELECT publication_key, unnest(range(1, len(l) + 1)) AS item_index, l FROM (SELECT publication_key, string_split(institutions, '; ') AS l FROM pub WHERE institutions <> ''))
SELECT publication_key, item_index, l[item_index] AS item FROM i""")
def multivalue_items(spark: SparkSession, folder: str) -> DataFrame:
    """List columns in long form, items numbered from 1."""
    pub = publications(spark, folder, "publication_key", "institutions")
    return pub.select("publication_key", F.posexplode(C.distinct_caseless(C.split_list(F.col("institutions")))).alias("p", "item")).select("publication_key", (F.col("p") + 1).cast("long").alias("item_index"), "item")


@query("multivalue_cells", """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(lang || ' ;' || source || ';;' || upper(lang) || '; ' || source, ';'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '; ') AS clean FROM l""")
def multivalue_cells(spark: SparkSession, folder: str) -> DataFrame:
    """List cells without repeats that differ in case only, in order of first mention."""
    raw = F.concat("lang", F.lit(" ;"), "source", F.lit(";;"), F.upper("lang"), F.lit("; "), "source")
    return table(spark, folder, "documents").select("doc_id", F.array_join(C.distinct_caseless(C.split_list(raw)), "; ").alias("clean"))


@query("search_text", """SELECT doc_id, trim(regexp_replace(lower(lang || ' ' || source || '  ' || coalesce(text, '')), '\\s+', ' ', 'g')) AS search_text, source = 'src0' AS missing_source FROM documents""")
def search_text(spark: SparkSession, folder: str) -> DataFrame:
    joined = F.concat("lang", F.lit(" "), "source", F.lit("  "), F.coalesce("text", F.lit("")))
    return table(spark, folder, "documents").select("doc_id", F.trim(F.regexp_replace(F.lower(joined), r"\s+", " ")).alias("search_text"), (F.col("source") == "src0").alias("missing_source"))


@query("title_keys", PUB_SQL + """ SELECT publication_key, trim(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) AS title_key, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS slug FROM pub""")
def title_keys(spark: SparkSession, folder: str) -> DataFrame:
    return publications(spark, folder, "publication_key", "title").select("publication_key", C.title_key(F.col("title")).alias("title_key"), C.slug(F.col("title")).alias("slug"))


@query("divergence_flags", """WITH l AS (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS found FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, found - o_orderkey % 7 AS difference, abs(found - o_orderkey % 7) >= 3 AS diverges FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def divergence_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of two sources compared; unknown where one is missing."""
    found = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("found"))
    joined = table(spark, folder, "orders").select("o_orderkey").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    difference = F.col("found") - F.col("o_orderkey") % 7
    return joined.select("o_orderkey", difference.alias("difference"), (F.abs(difference) >= 3).alias("diverges"))


@query("collaboration_type", PUB_SQL + """, c AS (SELECT publication_key, len(string_split(countries, '; ')) AS nc, len(string_split(institutions, '; ')) AS ni, countries FROM pub)
SELECT publication_key, CASE WHEN coalesce(countries, '') = '' THEN 'unresolved' WHEN nc > 1 THEN 'international' WHEN ni > 1 THEN 'multi_institution' ELSE 'single_institution' END AS collaboration FROM c""")
def collaboration_type(spark: SparkSession, folder: str) -> DataFrame:
    pub = publications(spark, folder, "publication_key", "countries", "institutions")
    kind = F.when(~C.present(F.col("countries")), "unresolved").when(F.size(C.split_list(F.col("countries"))) > 1, "international").when(F.size(C.split_list(F.col("institutions"))) > 1, "multi_institution").otherwise("single_institution")
    return pub.select("publication_key", kind.alias("collaboration"))


@query("publication_types", """SELECT p_type, CASE WHEN p_type = 'STANDARD' THEN 'article' WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'book' ELSE 'other' END AS standard_type, count(*) AS n FROM part GROUP BY ALL""")
def publication_types(spark: SparkSession, folder: str) -> DataFrame:
    """Types by alias first, then by ordered keyword rules."""
    raw = F.lower("p_type")
    standard = F.when(raw == "standard", "article").when(C.any_word(raw, "small", "medium", "large"), "book").otherwise("other")
    return table(spark, folder, "part").groupBy("p_type", standard.alias("standard_type")).agg(F.count("*").alias("n"))


@query("dominant_spelling", """WITH n AS (SELECT lower(p_name) AS k, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS name, count(*) AS c FROM part GROUP BY ALL)
SELECT k, name, c FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, len(regexp_replace(name, '[^a-z]', '', 'g')) DESC, name) = 1""")
def dominant_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent spelling of a name; of equal ones that with more lower-case letters."""
    name = F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    counted = table(spark, folder, "part").groupBy(F.lower("p_name").alias("k"), name.alias("name")).agg(F.count("*").alias("c"))
    best = counted.groupBy("k").agg(F.min(F.struct((-F.col("c")).alias("c"), (-F.length(F.regexp_replace("name", "[^a-z]", ""))).alias("l"), "name")).alias("b"))
    return best.select("k", "b.name", (-F.col("b.c")).alias("c"))


@query("issue_log", """WITH d AS (SELECT doc_id, lang AS raw_lang, CASE WHEN doc_id % 7 = 0 THEN upper(lang) ELSE lang END AS seen, source FROM documents)
SELECT doc_id, 'lang' AS field, seen AS before_value, raw_lang AS after_value FROM d WHERE seen <> raw_lang UNION ALL SELECT doc_id, 'source', source, upper(source) FROM d WHERE source <> upper(source)""")
def issue_log(spark: SparkSession, folder: str) -> DataFrame:
    """What cleaning changed: one row for each changed field."""
    seen = F.when(F.col("doc_id") % 7 == 0, F.upper("lang")).otherwise(F.col("lang"))
    pairs = [("lang", seen, F.lower(seen)), ("source", F.col("source"), F.upper("source"))]
    changed = F.array_compact(F.array(*(F.when(a != b, F.struct(F.lit(n).alias("field"), a.alias("before_value"), b.alias("after_value"))) for n, a, b in pairs)))
    return table(spark, folder, "documents").select("doc_id", F.explode(changed).alias("x")).select("doc_id", "x.*")


@query("orcid_check", """WITH d AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 15, '0') AS b FROM customer),
s AS (SELECT c_custkey, b, (12 - list_reduce(list_prepend(0, list_transform(range(1, 16), lambda i: CAST(substr(b, i, 1) AS BIGINT))), lambda acc, x: (acc + x) * 2) % 11) % 11 AS c FROM d)
SELECT c_custkey, b || CASE WHEN c = 10 THEN 'X' ELSE CAST(c AS VARCHAR) END AS full_id, TRUE AS valid, c = 3 AS ends_with_three FROM s""")
def orcid_check(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers with their check character: the one that the checker accepts."""
    body = F.lpad((F.col("c_custkey") * 7919).cast("string"), 15, "0")
    tries = F.array(*(F.lit(x) for x in "0123456789X"))
    rows = table(spark, folder, "customer").select("c_custkey", F.explode(F.transform(tries, lambda x: F.concat(body, x))).alias("full_id"))
    ok = rows.where(C.orcid(F.col("full_id")).isNotNull())
    return ok.select("c_custkey", "full_id", F.lit(True).alias("valid"), F.endswith("full_id", F.lit("3")).alias("ends_with_three"))


@query("emails", """SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS n FROM documents""")
def emails(spark: SparkSession, folder: str) -> DataFrame:
    """How many mail addresses each document holds."""
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), 1)
    return table(spark, folder, "documents").select("doc_id", F.size(found).cast("long").alias("n"))


@query("boilerplate_counts", """SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '(?i)licen[sc]ed under|all rights reserved|copyright')) AS boilerplate, count(*) FILTER (WHERE regexp_matches(text, '[^\\x00-\\x{024F}\\s]')) AS other_script FROM documents GROUP BY lang""")
def boilerplate_counts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "documents").groupBy("lang").agg(F.count_if(text.rlike("(?i)licen[sc]ed under|all rights reserved|copyright")).alias("boilerplate"), F.count_if(text.rlike(r"[^\x{0}-\x{24F}\s]")).alias("other_script"))


@query("page_titles")
def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of web pages with entities and markup resolved, and their citation metadata."""
    return html_titles(table(spark, folder, "pages"), "page_id", "html")


@query("author_names")
def author_names(spark: SparkSession, folder: str) -> DataFrame:
    """Author names parsed into surname and given tokens."""
    names = publications(spark, folder, "authors").select(F.explode(C.split_list(F.col("authors"))).alias("name")).distinct()
    return parsed_names(names, "name")


@query("inverted_index_text", """SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' ') AS abstract FROM documents""")
def inverted_index_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text put together again from an index word -> places, which stays in the text's row: nothing is shuffled."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return table(spark, folder, "documents").select("doc_id", inverted_index(words).alias("index")).select("doc_id", text_of_index(F.col("index")).alias("abstract"))
