"""Ownership and routing, identifier forms, per-author breakdowns, review exports, profile pages and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import identifiers as I
from ..operators import ownership
from ..registry import query
from ..sources.tables import PUB_SQL, publications, table

TARGET, POLICY = "CHINA", "v1"
_DECIDED = """WITH who AS (SELECT l_orderkey, l_linenumber, l_returnflag, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
head AS (SELECT l_orderkey, min(l_linenumber) AS k FROM who GROUP BY ALL),
c AS (SELECT o_orderkey, list_sort(list(DISTINCT n_name) FILTER (WHERE n_name IS NOT NULL)) AS every, list_sort(list(DISTINCT n_name) FILTER (WHERE l_linenumber = k)) AS head,
    list_sort(list(DISTINCT n_name) FILTER (WHERE l_returnflag = 'R' AND l_linenumber <= 2)) AS lead
  FROM orders LEFT JOIN who ON o_orderkey = l_orderkey LEFT JOIN head USING (l_orderkey) GROUP BY o_orderkey),
e AS (SELECT o_orderkey, coalesce(every, []) AS every, coalesce(head, []) AS head, coalesce(lead, []) AS lead FROM c),
f AS (SELECT *, list_contains(every, 'CHINA') AS here, len(list_filter(every, lambda x: x <> 'CHINA')) > 0 AS has_foreign, list_contains(lead, 'CHINA') AS led FROM e),
d AS (SELECT o_orderkey, has_foreign,
  CASE WHEN NOT here THEN 'NO_LK_PUBLICATION_AFFILIATION' WHEN lead = ['CHINA'] AND has_foreign THEN 'SL_OWNED_INTERNATIONAL' WHEN lead = ['CHINA'] THEN 'SL_DOMESTIC'
    WHEN led THEN 'CONFLICTING_CORRESPONDING_LEADERSHIP' WHEN len(lead) > 0 THEN 'FOREIGN_PROJECT_WITH_SL_PARTICIPATION'
    WHEN list_contains(head, 'CHINA') THEN 'FIRST_AUTHOR_ONLY_LK_EVIDENCE' ELSE 'MISSING_LEADERSHIP_EVIDENCE' END AS ownership_class,
  array_to_string(CASE WHEN NOT here THEN every WHEN len(lead) > 0 THEN lead WHEN list_contains(head, 'CHINA') THEN head ELSE every END, '; ') AS lead_country,
  CASE WHEN NOT here THEN CASE WHEN len(every) > 0 THEN 'HIGH' ELSE 'LOW' END WHEN len(lead) > 0 AND (lead = ['CHINA'] OR NOT led) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM f),
o AS (SELECT *, CASE WHEN ownership_class IN ('NO_LK_PUBLICATION_AFFILIATION', 'FOREIGN_PROJECT_WITH_SL_PARTICIPATION') THEN 'EXCLUDE'
  WHEN ownership_class LIKE 'SL_%' THEN 'INCLUDE' ELSE 'REVIEW' END AS decision FROM d)
"""


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    """(o_orderkey, decision, ownership_class, ...): countries of all, of first and of corresponding authors decide."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    who = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey").join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    who = who.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    lead = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 2)
    # one pass: the countries of each place, from which those of the first place are taken
    of = who.groupBy("l_orderkey").agg(F.collect_set("n_name").alias("every"), F.collect_set(F.when(lead, F.col("n_name"))).alias("lead"), F.collect_set(F.struct("l_linenumber", "n_name")).alias("places"))
    head = F.transform(F.filter("places", lambda p: p["l_linenumber"] == F.array_min("places")["l_linenumber"]), lambda p: p["n_name"])
    of = of.select("l_orderkey", ownership.decide(TARGET, F.col("every"), F.array_distinct(head), F.col("lead")).alias("x"))
    orders = table(spark, folder, "orders").select("o_orderkey")
    none = F.array().cast("array<string>")
    x = F.coalesce("x", ownership.decide(TARGET, none, none, none))
    return orders.join(of, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", x.alias("x")).select("o_orderkey", "x.*")


@query("ownership_decision", _DECIDED + "SELECT o_orderkey, decision, ownership_class, confidence, lead_country, has_foreign, decision = 'REVIEW' AS needs_review FROM o")
def ownership_decision(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder)


@query("ownership_routing", _DECIDED + """, r AS (SELECT o_orderkey, decision,
  decision = 'INCLUDE' AND o_orderkey % 13 <> 0 AND list_contains(string_split(lead_country, '; '), 'CHINA') AS ok, decision = 'REVIEW' AND o_orderkey % 4 = 0 AND o_orderkey % 3 = 1 AS repository FROM o)
SELECT o_orderkey, CASE WHEN decision = 'EXCLUDE' THEN 'excluded' WHEN ok THEN 'verified' ELSE 'review' END AS goes_to, ok OR repository AS in_final FROM r""")
def ownership_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Where each record goes: verified, excluded or review; repository records under review may stay in the final set."""
    version = F.when(F.col("o_orderkey") % 13 == 0, "v0").otherwise(POLICY)
    kind = F.when((F.col("decision") == "REVIEW") & (F.col("o_orderkey") % 4 == 0), "REPOSITORY_ONLY_EVIDENCE").otherwise(F.col("ownership_class"))
    source = F.when(F.col("o_orderkey") % 3 == 1, "openalex; repositories_combined").otherwise("openalex")
    ok = ownership.verified(TARGET, F.col("decision"), F.col("confidence"), F.col("needs_review"), F.col("lead_country"), version, POLICY)
    return _decided(spark, folder).select("o_orderkey", ownership.route(ok, F.col("decision")).alias("goes_to"), (ok | ownership.repository_only(source, F.col("decision"), kind)).alias("in_final"))


@query("identifier_forms", r"""WITH d AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, 'http', 'HTTP') || '#top' WHEN 1 THEN ' ' || url || ').' WHEN 2 THEN 'https://OpenAlex.org/w' || page_id ELSE '' END AS raw,
  CASE page_id % 3 WHEN 0 THEN lpad(CAST(page_id * 7919 AS VARCHAR), 8, '0') WHEN 1 THEN '1234 567' || CASE WHEN page_id % 2 = 0 THEN 'x' ELSE '' END ELSE '0000-' || page_id END AS code FROM pages),
t AS (SELECT *, nullif(regexp_replace(trim(raw), '[.,;:)\]}>"'']+$', ''), '') AS u, upper(replace(code, ' ', '')) AS k FROM d),
n AS (SELECT *, CASE WHEN u LIKE '%://%' THEN lower(regexp_extract(u, '^([^:]+)://([^/?#]+)([^#]*)', 1)) || '://' || lower(regexp_extract(u, '^([^:]+)://([^/?#]+)([^#]*)', 2)) || regexp_extract(u, '^([^:]+)://([^/?#]+)([^#]*)', 3) ELSE u END AS url FROM t)
SELECT page_id, url, CASE WHEN page_id % 4 = 2 THEN 'https://openalex.org/W' || page_id ELSE url END AS openalex_id, CASE WHEN regexp_full_match(k, '\d{4}-?\d{3}[\dX]') THEN left(k, 4) || '-' || right(k, 4) END AS issn FROM n""")
def identifier_forms(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    raw = F.when(i % 4 == 0, F.concat(F.replace("url", F.lit("http"), F.lit("HTTP")), F.lit("#top"))).when(i % 4 == 1, F.concat(F.lit(" "), "url", F.lit(")."))).when(i % 4 == 2, F.concat(F.lit("https://OpenAlex.org/w"), i)).otherwise("")
    code = F.when(i % 3 == 0, F.lpad((i * 7919).cast("string"), 8, "0")).when(i % 3 == 1, F.concat(F.lit("1234 567"), F.when(i % 2 == 0, "x").otherwise(""))).otherwise(F.concat(F.lit("0000-"), i))
    return table(spark, folder, "pages").select("page_id", I.url(raw).alias("url"), I.openalex_id(raw).alias("openalex_id"), I.issn(code).alias("issn"))


@query("doi_loose", r"""WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'HTTPS://doi.org/10.1/A' || doc_id || '/' WHEN 1 THEN 'doi:  10.2/b' WHEN 2 THEN ' N/A ' WHEN 3 THEN '//' WHEN 4 THEN 'http://dx.doi.org/10.3/c' END AS raw FROM documents)
SELECT doc_id, nullif(trim(CASE WHEN lower(trim(raw)) NOT IN ('', 'n/a') THEN trim(regexp_replace(regexp_replace(lower(trim(raw)), '^https?://(dx\.)?doi\.org/', ''), '^doi:\s*', '')) END, '/'), '') AS doi FROM d""")
def doi_loose(spark: SparkSession, folder: str) -> DataFrame:
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    raw = F.when(k == 0, F.concat(F.lit("HTTPS://doi.org/10.1/A"), i, F.lit("/"))).when(k == 1, "doi:  10.2/b").when(k == 2, " N/A ").when(k == 3, "//").when(k == 4, "http://dx.doi.org/10.3/c")
    return table(spark, folder, "documents").select("doc_id", I.doi_loose(raw).alias("doi"))


@query("author_display", """WITH d AS (SELECT c_custkey, c_mktsegment AS s, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
small AS (SELECT c_custkey, s, n, upper(s[1]) || lower(s[2:]) AS si, array_to_string(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS ni FROM d)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ni || ' ' || si WHEN 1 THEN ni WHEN 2 THEN s || ', ' || n || ', x' END AS display FROM small""")
def author_display(spark: SparkSession, folder: str) -> DataFrame:
    k, s, n = F.col("c_custkey") % 4, F.col("c_mktsegment"), F.col("n_name")
    raw = F.when(k == 0, F.concat(s, F.lit(" , "), n)).when(k == 1, n).when(k == 2, F.concat(s, F.lit(", "), n, F.lit(", x"))).otherwise(" ")
    return table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", I.display_name(raw).alias("display"))


@query("institution_breakdown", """WITH p AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)
SELECT l_suppkey AS author_id, coalesce(n_name, 'unattributed') AS institution, count(*) AS papers, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year
FROM p JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 9 <> 0 LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def institution_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """An author's papers by institution, with the years they span; papers without one are unattributed."""
    papers = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    place = table(spark, folder, "customer").where("c_custkey % 9 <> 0").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")).join(place, F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = papers.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("l_suppkey").alias("author_id"), F.coalesce("n_name", F.lit("unattributed")).alias("institution")).agg(F.count("*").alias("papers"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))


@query("institution_pairs", PUB_SQL + """, i AS (SELECT publication_key, publication_year, list_sort(string_split(institutions, '; ')) AS l FROM pub WHERE coalesce(institutions, '') <> ''),
x AS (SELECT *, unnest(range(1, len(l))) AS a FROM i), y AS (SELECT *, unnest(range(a + 1, len(l) + 1)) AS b FROM x)
SELECT publication_key, publication_year, l[a] AS source, l[b] AS target FROM y""")
def institution_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of each record, one row for a pair of its institutions, not added up."""
    pub = publications(spark, folder, "publication_key", "publication_year", "institutions").withColumn("l", F.array_sort(C.split_list(F.col("institutions"))))
    return pub.select("publication_key", "publication_year", "l", F.posexplode("l").alias("i", "source")).select("publication_key", "publication_year", "source", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("target"))


@query("review_export", PUB_SQL + """SELECT publication_key, title, status, coalesce(nullif(reviewer, ''), 'unassigned') AS reviewer
FROM pub JOIN (SELECT doc_id, CASE quality WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'r' || doc_id % 5 WHEN doc_id % 3 = 1 THEN '' END AS reviewer FROM labels) r
  ON publication_key = 'source:openalex:' || doc_id WHERE status = 'accepted'""")
def review_export(spark: SparkSession, folder: str) -> DataFrame:
    """Publications whose review accepted them, with the reviewer where there is one."""
    i = F.col("doc_id")
    reviewer = F.when(i % 3 == 0, F.concat(F.lit("r"), (i % 5).cast("string"))).when(i % 3 == 1, "")
    reviews = table(spark, folder, "labels").where("quality = 1").select(F.concat(F.lit("source:openalex:"), i.cast("string")).alias("publication_key"), F.lit("accepted").alias("status"), F.coalesce(C.nonblank(reviewer), F.lit("unassigned")).alias("reviewer"))
    return publications(spark, folder, "publication_key", "title").join(reviews, "publication_key")


@query("profile_page", """WITH own AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3))
SELECT o_orderkey, (SELECT count(*) FROM own) AS total FROM own ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 10""")
def profile_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of a profile's publications, newest first, each row with the number of all."""
    claimed = table(spark, folder, "lineitem").where("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    own = table(spark, folder, "orders").select("o_orderkey", "o_orderdate").join(claimed, "o_orderkey", "left_semi")
    page = own.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(10).limit(10)
    return page.crossJoin(F.broadcast(own.agg(F.count("*").alias("total")))).select("o_orderkey", "total")  # one row


_FIELDS = ("doi", "citation_count", "is_oa", "authors")


@query("completeness_matrix", PUB_SQL + "".join(f"{' UNION ALL ' if k else ', m AS ('}SELECT source_dataset, '{c}' AS field, nullif(trim(CAST({c} AS VARCHAR)), '') IS NOT NULL AS has FROM pub" for k, c in enumerate(_FIELDS)) + """)
SELECT field, round(100.0 * count(*) FILTER (WHERE has AND source_dataset = 'openalex') / count(*) FILTER (WHERE source_dataset = 'openalex'), 4) AS openalex,
  round(100.0 * count(*) FILTER (WHERE has AND source_dataset = 'repositories_combined') / count(*) FILTER (WHERE source_dataset = 'repositories_combined'), 4) AS repositories_combined FROM m GROUP BY field""")
def completeness_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """How full each field is in each source, fields down and sources across."""
    sources = ["openalex", "repositories_combined"]
    pub = publications(spark, folder, "source_dataset", *_FIELDS).where(F.col("source_dataset").isin(*sources))
    has = F.array(*(F.struct(F.lit(c).alias("field"), C.present(F.col(c)).cast("int").alias("has")) for c in _FIELDS))
    return pub.select("source_dataset", F.explode(has).alias("x")).groupBy("x.field").pivot("source_dataset", sources).agg(F.round(100 * F.avg("x.has"), 4))


@query("loadable_rows", PUB_SQL + "SELECT publication_key FROM pub WHERE doi LIKE '10.%' AND type IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND is_oa")
def loadable_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Records for the database: an accepted label, owned, with a valid DOI."""
    pub = publications(spark, folder, "publication_key", "doi", "type", "is_oa")
    return pub.where(F.col("type").isin("1-URGENT", "2-HIGH", "3-MEDIUM") & F.coalesce("is_oa", F.lit(False)) & C.is_doi(F.col("doi"))).select("publication_key")


@query("merge_by_priority", """WITH r AS (SELECT o_orderkey, o_custkey % 500 AS k, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS priority FROM orders)
SELECT k AS group_key, o_orderkey AS kept, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, o_orderkey) AS place, count(*) OVER (PARTITION BY k) AS n FROM r) WHERE place = 1""")
def merge_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Of each group of copies the row of the best source, the first one of equals; completeness does not count."""
    i = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(i, (F.col("o_custkey") % 500).alias("group_key"), F.when(i % 3 == 0, 1).when(i % 3 == 1, 3).otherwise(2).alias("priority"))
    return rows.groupBy("group_key").agg(F.min(F.struct("priority", "o_orderkey")).alias("best"), F.count("*").alias("n")).select("group_key", F.col("best.o_orderkey").alias("kept"), "n")


@query("group_risks", PUB_SQL + """SELECT primary_field || ' ' || type AS title_group, max(publication_year) - min(publication_year) AS year_span, count(*) AS records, count(*) FILTER (WHERE regexp_matches(title, '(?i)\\b(erratum|correction|study [0-9]*00)\\b')) AS artifacts
FROM pub GROUP BY ALL""")
def group_risks(spark: SparkSession, folder: str) -> DataFrame:
    """What speaks against a group of copies: the years that it spans and titles that look like corrections."""
    pub = publications(spark, folder, "primary_field", "type", "publication_year", "title")
    odd = F.col("title").rlike(r"(?i)\b(erratum|correction|study [0-9]*00)\b")
    return pub.groupBy(F.concat_ws(" ", "primary_field", "type").alias("title_group")).agg((F.max("publication_year") - F.min("publication_year")).alias("year_span"), F.count("*").alias("records"), F.count_if(odd).alias("artifacts"))


@query("evidence_join", """SELECT s_suppkey, coalesce(CASE WHEN v.score >= 40 THEN v.place END, s_name) AS location, CASE WHEN v.score >= 40 THEN 'evidence' WHEN v.score IS NOT NULL THEN 'too weak' ELSE 'none' END AS status
FROM supplier LEFT JOIN (SELECT user_id, max_by(event_type, (value, event_id)) AS place, max(value) AS score FROM events GROUP BY user_id) v ON user_id = s_suppkey""")
def evidence_join(spark: SparkSession, folder: str) -> DataFrame:
    """A registry takes the best piece of evidence for an entry, where it is strong enough."""
    best = table(spark, folder, "events").groupBy("user_id").agg(F.max(F.struct("value", "event_id", "event_type")).alias("b"))
    joined = table(spark, folder, "supplier").join(best, F.col("user_id") == F.col("s_suppkey"), "left")
    strong = F.col("b.value") >= 40
    return joined.select("s_suppkey", F.coalesce(F.when(strong, F.col("b.event_type")), F.col("s_name")).alias("location"), F.when(strong, "evidence").when(F.col("b").isNotNull(), "too weak").otherwise("none").alias("status"))


@query("feedback_context", PUB_SQL + """SELECT conv_id, turn, publication_key, title FROM (SELECT conv_id, turn, 'source:openalex:' || conv_id AS publication_key FROM conversations WHERE role = 'user') f LEFT JOIN pub USING (publication_key)""")
def feedback_context(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback with the publication that it is on, where that still exists."""
    feedback = table(spark, folder, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("source:openalex:"), F.col("conv_id").cast("string")).alias("publication_key"))
    return feedback.join(publications(spark, folder, "publication_key", "title"), "publication_key", "left").select("conv_id", "turn", "publication_key", "title")


@query("duplicate_lookup", """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN '10.1/' || o_orderkey % 1000 END AS doi, regexp_replace(lower(o_orderpriority || o_custkey || strftime(o_orderdate, '%Y%m')), '[^a-z0-9]+', '', 'g') AS k FROM orders),
m AS (SELECT a.o_orderkey AS asked, b.o_orderkey AS found FROM p a JOIN p b ON a.doi = b.doi WHERE a.o_orderkey % 50 = 0 AND a.o_orderkey <> b.o_orderkey
  UNION SELECT a.o_orderkey, b.o_orderkey FROM p a JOIN p b ON a.k = b.k WHERE a.o_orderkey % 50 = 0 AND len(a.k) >= 12 AND a.o_orderkey <> b.o_orderkey)
SELECT asked, found, o_orderstatus IN ('F', 'O') AS is_public FROM m JOIN orders ON o_orderkey = found QUALIFY row_number() OVER (PARTITION BY asked ORDER BY found) <= 5""")
def duplicate_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five stored records with the DOI or the title key of the one asked about, and whether each is public."""
    i = F.col("o_orderkey")
    doi = F.when(i % 5 != 0, F.concat(F.lit("10.1/"), (i % 1000).cast("string")))
    key = F.regexp_replace(F.lower(F.concat("o_orderpriority", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMM"))), "[^a-z0-9]+", "")
    stored = table(spark, folder, "orders").select(i.alias("found"), F.col("o_orderstatus").isin("F", "O").alias("is_public"), doi.alias("doi"), key.alias("key"))
    names = F.array_compact(F.array(F.when(F.col("doi").isNotNull(), F.concat(F.lit("d"), "doi")), F.when(F.length("key") >= 12, F.concat(F.lit("t"), "key"))))
    rows = stored.select("found", "is_public", F.explode(names).alias("name"))
    asked = rows.where("found % 50 = 0").select(F.col("found").alias("asked"), "name")
    met = asked.join(rows, "name").where("asked <> found").select("asked", "found", "is_public").distinct()
    return met.withColumn("at", F.row_number().over(Window.partitionBy("asked").orderBy("found"))).where("at <= 5").drop("at")
