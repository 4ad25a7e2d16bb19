"""Venues, institutions, people's names, scraped records, rosters and topic rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import venues as V
from ..functions.rules import transformed
from ..registry import query
from ..sources.tables import PUB_SQL, publications, table

_ORGANISATIONS_SQL = "|".join(V.ORGANISATIONS)


def _by_nation(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Orders with their customer's segment and nation."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", *columns).join(customer, F.col("o_custkey") == F.col("c_custkey"))


def _dominant(names: DataFrame, key: Column) -> DataFrame:
    """(k, best): the most frequent spelling, then that with more lower-case letters, then the last one."""
    counted = names.where(key.isNotNull()).groupBy(key.alias("k"), "name").agg(F.sum("c").alias("c"))
    order = F.struct("c", F.length(F.regexp_replace("name", "[^a-z]", "")).alias("low"), "name")
    return counted.groupBy("k").agg(F.max(order).alias("b")).select("k", F.col("b.name").alias("best"))


@query("venue_canonical", rf"""WITH r AS (SELECT o_orderkey, 'Journal of ' || n_name || ' ' || c_mktsegment AS b, CASE WHEN o_orderkey % 3 = 0 THEN '1000-' || c_nationkey END AS issn
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT o_orderkey, issn, CASE o_orderkey % 7 WHEN 0 THEN upper(b) WHEN 1 THEN b || ' (Springer Nature)' WHEN 2 THEN b || ' (Applied Series)' WHEN 3 THEN '"' || b || '.,"' WHEN 4 THEN ' ' WHEN 5 THEN lower(b) ELSE b END AS raw FROM r),
n AS (SELECT o_orderkey, issn, nullif(trim(regexp_replace(trim(raw), '\s+', ' ', 'g'), ' "''.,;'), '') AS name FROM v),
f AS (SELECT lower(name) AS k, name AS best FROM n WHERE name IS NOT NULL GROUP BY name QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY count(*) DESC, len(regexp_replace(name, '[^a-z]', '', 'g')) DESC, name DESC) = 1),
i AS (SELECT issn, name AS best FROM n WHERE name IS NOT NULL AND issn IS NOT NULL GROUP BY issn, name QUALIFY row_number() OVER (PARTITION BY issn ORDER BY count(*) DESC, len(regexp_replace(name, '[^a-z]', '', 'g')) DESC, name DESC) = 1),
c AS (SELECT o_orderkey, name, n.issn, f.best AS own, i.best AS by_issn, regexp_extract(f.best, '^(.*?)\s*\(([^()]*)\)$', 1) AS short, regexp_extract(f.best, '^(.*?)\s*\(([^()]*)\)$', 2) AS bracket FROM n LEFT JOIN f ON lower(name) = f.k LEFT JOIN i ON n.issn = i.issn),
s AS (SELECT *, CASE WHEN short <> '' AND bracket <> '' AND (lower(bracket) = lower(short) OR regexp_matches(lower(bracket), '{_ORGANISATIONS_SQL}')) THEN short ELSE own END AS cut FROM c)
SELECT o_orderkey, CASE WHEN name IS NOT NULL THEN coalesce(by_issn, f.best, own) END AS venue FROM s LEFT JOIN f ON lower(cut) = f.k""")
def venue_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's venue: by its ISSN, else the dominant spelling, without the publisher where the shorter name is in use."""
    i, b = F.col("o_orderkey"), F.concat(F.lit("Journal of "), "n_name", F.lit(" "), "c_mktsegment")
    raw = F.when(i % 7 == 0, F.upper(b)).when(i % 7 == 1, F.concat(b, F.lit(" (Springer Nature)"))).when(i % 7 == 2, F.concat(b, F.lit(" (Applied Series)"))).when(i % 7 == 3, F.concat(F.lit('"'), b, F.lit('.,"'))).when(i % 7 == 4, " ").when(i % 7 == 5, F.lower(b)).otherwise(b)
    rows = _by_nation(spark, folder).select(i, V.venue_name(raw).alias("name"), F.when(i % 3 == 0, F.concat(F.lit("1000-"), F.col("c_nationkey").cast("string"))).alias("issn"))
    used = rows.where("name IS NOT NULL").groupBy("name", "issn").agg(F.count("*").alias("c"))
    by_name, by_issn = _dominant(used, F.lower("name")), _dominant(used, F.col("issn"))
    # a name's canonical form is worked out once for each spelling in use, not for each record
    short = by_name.select("k", "best", F.lower(V.without_publisher(F.col("best"))).alias("cut"))
    canonical = short.join(by_name.select(F.col("k").alias("cut"), F.col("best").alias("shorter")), "cut", "left").select("k", F.coalesce("shorter", "best").alias("own"))
    joined = rows.withColumn("k", F.lower("name")).join(canonical, "k", "left").join(by_issn.select(F.col("k").alias("issn"), F.col("best").alias("by_issn")), "issn", "left")
    return joined.select("o_orderkey", F.when(F.col("name").isNotNull(), F.coalesce("by_issn", "own")).alias("venue"))


@query("venue_kinds", """WITH v AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'bioRxiv ' || p_brand WHEN 1 THEN p_name || ' Dataverse' WHEN 2 THEN p_type || ' Institutional Repository' WHEN 3 THEN 'Europe PMC ' || p_name
  WHEN 4 THEN 'Workshop on ' || p_type WHEN 5 THEN p_brand || ' eBooks' WHEN 6 THEN 'Annals of ' || p_type WHEN 7 THEN '  ' ELSE p_name END AS name, p_partkey % 2 = 0 AS issn FROM part)
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'preprint_server' WHEN 1 THEN 'data_repository' WHEN 2 THEN 'institutional_repository' WHEN 3 THEN 'aggregator' WHEN 4 THEN 'conference' WHEN 5 THEN 'book_series'
  WHEN 7 THEN 'unknown' ELSE CASE WHEN issn OR regexp_matches(lower(name), 'annals') THEN 'journal' ELSE 'other_venue' END END AS kind FROM v""")
def venue_kinds(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("p_partkey")
    forms = [("bioRxiv ", "p_brand", ""), ("", "p_name", " Dataverse"), ("", "p_type", " Institutional Repository"), ("Europe PMC ", "p_name", ""), ("Workshop on ", "p_type", ""), ("", "p_brand", " eBooks"), ("Annals of ", "p_type", "")]
    name = F.when(i % 9 == 7, "  ")
    for k, (before, column, after) in enumerate(forms):
        name = name.when(i % 9 == k, F.concat(F.lit(before), column, F.lit(after)))
    return table(spark, folder, "part").select(i, V.venue_kind(V.venue_name(name.otherwise(F.col("p_name"))), i % 2 == 0).alias("kind"))


_COUNTRIES = {"india": "IN", "sri lanka": "LK", "united kingdom": "GB"}


@query("affiliation_parts", """WITH d AS (SELECT c_custkey, c_custkey % 5 AS k, c_mktsegment AS s FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN s || ' University' WHEN 1 THEN 'Rajarata University of Sri Lanka; ' || s || ' Institute' WHEN 2 THEN 'Faculty of ' || s WHEN 3 THEN '' ELSE s || ' College, London' END AS institutions,
  CASE k WHEN 0 THEN 'IN' WHEN 1 THEN 'LK; GB' WHEN 4 THEN 'GB' ELSE '' END AS countries FROM d""")
def affiliation_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Institutions and countries of affiliation texts with departments before and countries after the name."""
    k, s = F.col("c_custkey") % 5, F.col("c_mktsegment")
    text = (
        F.when(k == 0, F.concat(F.lit("Dept. of Physics, Faculty of "), s, F.lit(", "), s, F.lit(" University, India; "), s, F.lit(" University")))
        .when(k == 1, F.concat(F.lit("Rajarata University of Sri Lanka; "), s, F.lit(" Institute, United Kingdom"))).when(k == 2, F.concat(F.lit("Faculty of "), s)).when(k == 3, " ; ")
        .otherwise(F.concat(F.lit("The Library, "), s, F.lit(" College, London, united kingdom")))
    )
    parts = table(spark, folder, "customer").select("c_custkey", V.affiliation_parts(text, _COUNTRIES).alias("x"))
    return parts.select("c_custkey", F.array_join("x.institutions", "; ").alias("institutions"), F.array_join("x.countries", "; ").alias("countries"))


@query("institution_cascade", """WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT n_name)) AS names FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(names, []) ELSE [] END AS given, CASE WHEN o_orderkey % 4 < 2 THEN 'src' || c_nationkey END AS source_id,
    CASE WHEN o_orderkey % 5 > 1 THEN [n_name, c_mktsegment || ' Institute'] ELSE [] END AS affiliations FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN p ON o_orderkey = l_orderkey),
s AS (SELECT r.*, CASE WHEN n_nationkey < 20 THEN [n_name] ELSE [] END AS harvested FROM r LEFT JOIN nation ON source_id = 'src' || n_nationkey),
t AS (SELECT *, CASE WHEN len(given) > 0 THEN given WHEN len(harvested) > 0 THEN harvested ELSE [] END AS first FROM s)
SELECT o_orderkey, array_to_string(list_concat(first, list_filter(affiliations, lambda x: NOT list_contains(first, x))), '; ') AS institutions,
  CASE WHEN len(given) > 0 THEN 'metadata' WHEN len(harvested) > 0 THEN 'source_institution_id' WHEN len(affiliations) > 0 THEN 'author_affiliations' ELSE 'none' END AS institution_source FROM t""")
def institution_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """A record's institutions from its metadata, else from the repository it came from; affiliations fill gaps and add more."""
    i, none = F.col("o_orderkey"), F.array().cast("array<string>")
    given = publications(spark, folder, "publication_key", "institutions").select(F.substring_index("publication_key", ":", -1).cast("long").alias("o_orderkey"), C.split_list(F.col("institutions")).alias("names"))
    rows = _by_nation(spark, folder).join(given, "o_orderkey").select(
        i, F.when(i % 3 == 0, F.col("names")).otherwise(none).alias("given"), F.when(i % 4 < 2, F.concat(F.lit("src"), F.col("c_nationkey").cast("string"))).alias("source_id"),
        F.when(i % 5 > 1, F.array("n_name", F.concat("c_mktsegment", F.lit(" Institute")))).otherwise(none).alias("affiliations"),
    )
    registry = table(spark, folder, "nation").where("n_nationkey < 20").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source_id"), F.array("n_name").alias("found"))
    rows = rows.join(registry, "source_id", "left").withColumn("harvested", F.coalesce("found", none))
    some = lambda c: F.size(c) > 0
    first = F.when(some("given"), F.col("given")).otherwise(F.col("harvested"))
    label = F.when(some("given"), "metadata").when(some("harvested"), "source_institution_id").when(some("affiliations"), "author_affiliations").otherwise("none")
    return rows.select("o_orderkey", F.array_join(F.array_union(first, F.col("affiliations")), "; ").alias("institutions"), label.alias("institution_source"))


@query("name_matches", """WITH d AS (SELECT c_custkey, c_custkey % 8 AS k, c_mktsegment AS s FROM customer)
SELECT c_custkey, CASE WHEN k IN (0, 3) THEN 'exact' WHEN k IN (1, 2, 5) THEN 'initials' ELSE 'none' END AS agreement FROM d""")
def name_matches(spark: SparkSession, folder: str) -> DataFrame:
    """How listed names agree with a profile's name, with surnames first, initials, other orders, other people and blanks."""
    k, s = F.col("c_custkey") % 8, F.col("c_mktsegment")
    listed = (
        F.when(k == 0, F.concat(s, F.lit(", Nimal Anura"))).when(k == 1, F.concat(F.lit("N. "), s)).when(k == 2, F.concat(s, F.lit(" A"))).when(k == 3, F.concat(F.lit("nimal ANURA "), s))
        .when(k == 4, F.concat(F.lit("Kamal "), s)).when(k == 5, s).when(k == 6, "Nimal Anura Other")
    )
    return table(spark, folder, "customer").select("c_custkey", V.name_match(listed, F.concat(F.lit("Nimal Anura "), s)).alias("agreement"))


@query("profile_evidence", """WITH d AS (SELECT c_custkey, c_name, c_custkey % 6 AS k FROM customer)
SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE k WHEN 0 THEN 'free_webmail' WHEN 1 THEN 'academic' WHEN 2 THEN 'academic' WHEN 3 THEN 'sri_lankan_organisation' WHEN 4 THEN 'other' ELSE 'unknown' END AS mail,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey || '-' || (c_custkey + 9) WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey + 9 AS VARCHAR) END AS pages FROM d""")
def profile_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """A profile's slug, what its mail domain says, and page ranges."""
    i = F.col("c_custkey")
    domain = F.array(*(F.lit(x) for x in (" x@GMail.com ", "x@cs.ac.lk", "x@mit.edu", "x@firm.lk", "x@firm.com", "nobody")))[(i % 6).cast("int")]
    return table(spark, folder, "customer").select(i, C.slug(F.col("c_name")).alias("slug"), V.mail_kind(domain).alias("mail"), V.page_range(F.when(i % 3 < 2, i), F.when(i % 3 != 1, i + 9)).alias("pages"))


@query("scraped_merge", """WITH s AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'd' || user_id END AS doi, 'r' || event_id % 5000 AS record, CASE WHEN value > 20 THEN event_type END AS title, CASE WHEN event_id % 2 = 0 THEN 'k' || user_id END AS keywords FROM events),
k AS (SELECT doi AS key, s.* FROM s WHERE doi IS NOT NULL UNION ALL SELECT record, s.* FROM s),
b AS (SELECT key, title, keywords FROM k WHERE title IS NOT NULL OR keywords IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY (title IS NOT NULL)::INT + (keywords IS NOT NULL)::INT DESC, event_id) = 1),
c AS (SELECT o_orderkey, 'd' || o_orderkey AS doi, 'r' || o_orderkey % 5000 AS record, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS title FROM orders)
SELECT o_orderkey, coalesce(c.title, CASE WHEN x.key IS NOT NULL THEN x.title ELSE y.title END) AS title, CASE WHEN x.key IS NOT NULL THEN x.keywords ELSE y.keywords END AS keywords,
  CASE WHEN x.key IS NOT NULL THEN 'doi' WHEN y.key IS NOT NULL THEN 'record' END AS matched FROM c LEFT JOIN b x ON c.doi = x.key LEFT JOIN b y ON c.record = y.key""")
def scraped_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Scraped titles and keywords fill blanks: by DOI, else by record id, from the fullest scraped record of the key."""
    i, e = F.col("o_orderkey"), F.col("event_id")
    scraped = table(spark, folder, "events").select(e, F.when(F.col("value") > 20, F.col("event_type")).alias("title"), F.when(e % 2 == 0, F.concat(F.lit("k"), F.col("user_id").cast("string"))).alias("keywords"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("d"), F.col("user_id").cast("string"))).alias("doi"), F.concat(F.lit("r"), (e % 5000).cast("string")).alias("record"))
    filled = F.col("title").isNotNull().cast("int") + F.col("keywords").isNotNull().cast("int")
    keyed = scraped.withColumn("filled", filled).where("filled > 0").select("event_id", "filled", "title", "keywords", F.explode(F.array_compact(F.array("doi", "record"))).alias("key"))
    best = keyed.groupBy("key").agg(F.min(F.struct((-F.col("filled")).alias("f"), "event_id", "title", "keywords")).alias("b"))
    asked = table(spark, folder, "orders").select(i, F.posexplode(F.array(F.concat(F.lit("d"), i.cast("string")), F.concat(F.lit("r"), (i % 5000).cast("string")))).alias("at", "key"))
    found = asked.join(best, "key").groupBy("o_orderkey").agg(F.min(F.struct("at", "b")).alias("m"))
    current = table(spark, folder, "orders").select(i, F.when(i % 3 > 0, F.col("o_orderpriority")).alias("title")).join(found, "o_orderkey", "left")
    return current.select("o_orderkey", F.coalesce("title", "m.b.title").alias("title"), F.col("m.b.keywords").alias("keywords"), F.when(F.col("m.at") == 0, "doi").when(F.col("m.at") == 1, "record").alias("matched"))


@query("roster_records", PUB_SQL + """, roster AS (SELECT lower(s_name) AS alias, s_suppkey FROM supplier WHERE s_nationkey = 3),
a AS (SELECT publication_key, lower(trim(unnest(string_split(authors, ';')))) AS alias FROM pub),
m AS (SELECT publication_key, count(DISTINCT s_suppkey) AS staff FROM a JOIN roster USING (alias) GROUP BY ALL),
r AS (SELECT pub.*, staff, coalesce(nullif(trim(doi), ''), type || '|' || primary_field || '|' || publication_year) AS key,
    (nullif(trim(doi), '') IS NOT NULL)::INT + (citation_count IS NOT NULL)::INT + (is_oa IS NOT NULL)::INT + (coalesce(topics, '') <> '')::INT AS filled FROM pub JOIN m USING (publication_key) WHERE list_contains(string_split(institutions, '; '), 'NATION_3'))
SELECT key, arg_min(publication_key, (-filled, publication_key)) AS kept, arg_min(citation_count, (-filled, publication_key)) FILTER (WHERE citation_count IS NOT NULL) AS citation_count,
  bool_or(source_dataset LIKE '%openalex%') AS in_openalex, bool_or(source_dataset LIKE '%repositories%') AS in_repositories, max(staff) AS staff, count(*) AS n FROM r GROUP BY key""")
def roster_records(spark: SparkSession, folder: str) -> DataFrame:
    """A department's records: by staff names and affiliation, one of each key, the fullest first; blanks are filled, flags joined."""
    roster = table(spark, folder, "supplier").where("s_nationkey = 3").select(F.lower("s_name").alias("alias"), "s_suppkey")
    pub = publications(spark, folder, "publication_key", "publication_year", "type", "primary_field", "doi", "citation_count", "is_oa", "topics", "source_dataset", "institutions", "authors")
    ours = pub.where(F.array_contains(C.split_list(F.col("institutions")), "NATION_3"))
    staff = ours.select("publication_key", F.explode(F.transform(C.split_list(F.col("authors")), lambda x: F.lower(x))).alias("alias")).join(roster, "alias")
    staff = staff.groupBy("publication_key").agg(F.countDistinct("s_suppkey").alias("staff"))
    filled = sum((C.present(F.col(c)).cast("int") for c in ("doi", "citation_count", "is_oa", "topics")), F.lit(0))
    key = F.coalesce(F.when(C.present(F.col("doi")), F.trim("doi")), F.concat_ws("|", "type", "primary_field", F.col("publication_year").cast("string")))
    rows = ours.join(staff, "publication_key").select(key.alias("key"), (-filled).alias("f"), "publication_key", "citation_count", "source_dataset", "staff")
    return rows.groupBy("key").agg(
        F.min(F.struct("f", "publication_key"))["publication_key"].alias("kept"),
        F.min(F.when(F.col("citation_count").isNotNull(), F.struct("f", "publication_key", "citation_count")))["citation_count"].alias("citation_count"),
        F.bool_or(F.contains("source_dataset", F.lit("openalex"))).alias("in_openalex"), F.bool_or(F.contains("source_dataset", F.lit("repositories"))).alias("in_repositories"),
        F.max("staff").alias("staff"), F.count("*").alias("n"),
    )


@query("profile_spellings", """WITH named AS (SELECT l_orderkey, l_suppkey, CASE l_orderkey % 3 WHEN 0 THEN upper(s_name) WHEN 1 THEN s_name ELSE replace(s_name, 'Supplier', 'S.') END AS spelling FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
claims AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1)
SELECT c.l_suppkey AS profile_id, spelling, count(DISTINCT c.l_orderkey) AS publications FROM claims c JOIN named n ON c.l_orderkey = n.l_orderkey AND c.l_suppkey = n.l_suppkey JOIN orders ON o_orderkey = c.l_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def profile_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """How a profile's name is spelled in the public publications that it claims."""
    i = F.col("l_orderkey")
    lines = table(spark, folder, "lineitem")
    spelling = F.when(i % 3 == 0, F.upper("s_name")).when(i % 3 == 1, F.col("s_name")).otherwise(F.replace("s_name", F.lit("Supplier"), F.lit("S.")))
    # a claim and the names of its publication share the publication and the person: one grouping serves both
    own = lines.groupBy("l_orderkey", "l_suppkey").agg(F.bool_or(F.col("l_linenumber") == 1).alias("claimed")).where("claimed")
    public = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    named = own.join(public, "l_orderkey", "left_semi").join(table(spark, folder, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return named.groupBy(F.col("l_suppkey").alias("profile_id"), spelling.alias("spelling")).agg(F.count("*").alias("publications"))


@query("topic_ranking", PUB_SQL + """, t AS (SELECT publication_year AS y, unnest(string_split(topics, '; ')) AS topic FROM pub WHERE topics IS NOT NULL), n AS (SELECT publication_year AS y, count(*) AS total FROM pub WHERE topics IS NOT NULL GROUP BY 1), c AS (SELECT topic, y, count(*) AS c FROM t GROUP BY ALL)
SELECT topic, CAST(sum(c) AS BIGINT) AS publications, round(sum(c / total) / (SELECT count(*) FROM n), 8) AS mean_share, min(y) AS first_year, max(y) AS last_year FROM c JOIN n USING (y) GROUP BY topic""")
def topic_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Topics by their publications, with their mean share of a year's publications."""
    pub = publications(spark, folder, "publication_year", "topics").where("topics IS NOT NULL")
    # an empty topic counts a year's publications in the same pass
    marked = pub.select("publication_year", F.explode(F.concat(F.array(F.lit("")), C.split_list(F.col("topics")))).alias("topic"))
    counted = marked.groupBy("topic", "publication_year").agg(F.count("*").alias("c"))
    totals = counted.where("topic = ''").select("publication_year", F.col("c").alias("total"))
    shares = counted.where("topic <> ''").join(totals, "publication_year")
    of = shares.groupBy("topic").agg(F.sum("c").alias("publications"), F.sum(F.col("c") / F.col("total")).alias("s"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"))
    years = totals.agg(F.count("*").alias("years"))  # one row
    return of.crossJoin(F.broadcast(years)).select("topic", "publications", F.round(F.col("s") / F.col("years"), 8).alias("mean_share"), "first_year", "last_year").orderBy(F.desc("publications"), "topic")


@query("model_keywords", PUB_SQL + """, k AS (SELECT publication_key, array_to_string(list_sort(list_distinct(list_transform(string_split(lower(topics), ';'), lambda x: trim(x)))), '; ') AS keywords FROM pub WHERE coalesce(topics, '') <> '')
SELECT keywords, min(publication_key) AS publication_key, count(*) AS n FROM k GROUP BY keywords""")
def model_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword sets for a model, each once: lower case, without repeats, in order."""
    pub = publications(spark, folder, "publication_key", "topics").where(C.present(F.col("topics")))
    return pub.groupBy(F.array_join(F.array_sort(F.array_distinct(C.split_list(F.lower("topics")))), "; ").alias("keywords")).agg(F.min("publication_key").alias("publication_key"), F.count("*").alias("n"))


_RULES = {"year": {"type": "extract_year"}, "items": {"type": "split", "separator": "|"}, "words": {"type": "normalize_list"}, "doi": {"type": "normalize_doi"}, "day": {"type": "normalize_date"}, "title": {"type": "normalize_text"}, "absent": {"type": "strip"}}


@query("configured_transforms", """WITH d AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderpriority AS p, o_orderdate AS t FROM orders)
SELECT o_orderkey, CASE WHEN k < 2 THEN year(t) END AS year, p || '~x.y' AS items, CASE WHEN k = 0 THEN 'a~b, c' WHEN k = 1 THEN 'a~b' ELSE '' END AS words, CASE WHEN k < 2 THEN '10.1000/' || o_orderkey END AS doi,
  CASE k WHEN 0 THEN strftime(t, '%Y-%m-%d') WHEN 1 THEN strftime(t, '%Y') END AS day, CASE WHEN k > 0 THEN p || ' study' END AS title FROM d""")
def configured_transforms(spark: SparkSession, folder: str) -> DataFrame:
    """Columns under rules from a configuration; lists are joined for the comparison."""
    i, p, t = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderdate")
    k = i % 3
    raw = table(spark, folder, "orders").select(
        i, F.when(k < 2, F.concat(F.lit("c. "), F.year(t).cast("string"))).otherwise("none").alias("year"), F.concat(F.lit(" | "), p, F.lit(" |x.y|")).alias("items"),
        F.when(k == 0, " a; b, c ;").when(k == 1, "a,b").alias("words"), F.when(k < 2, F.concat(F.lit("https://doi.org/10.1000/"), i.cast("string"), F.lit("."))).alias("doi"),
        F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.concat(F.date_format(t, "yyyy"), F.lit("-13-01"))).alias("day"), F.when(k > 0, F.concat(F.lit("  "), p, F.lit("   study "))).otherwise("  ").alias("title"),
    )
    done = transformed(raw, _RULES)
    return done.select("o_orderkey", "year", F.array_join("items", "~").alias("items"), F.array_join("words", "~").alias("words"), "doi", "day", "title")
