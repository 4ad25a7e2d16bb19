"""Data quality: validation, completeness, profiles, drift, operations figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import is_doi, present
from ..registry import query
from ..sources.tables import PUB_SQL, publications, table

_ERRORS_SQL = PUB_SQL + """, e AS (SELECT publication_key, list_filter([CASE WHEN trim(coalesce(doi, '')) = '' THEN 'missing_doi' END, CASE WHEN publication_year NOT BETWEEN 1996 AND 2000 THEN 'year_out_of_range' END,
  CASE WHEN citation_count IS NULL THEN 'missing_citations' END, CASE WHEN coalesce(authors, '') = '' AND coalesce(institutions, '') = '' THEN 'no_people' END], lambda x: x IS NOT NULL) AS errors FROM pub)"""


def with_errors(pub: DataFrame) -> DataFrame:
    """Records with ``errors``: the rules that they break, in order."""
    rules = [(~present(F.col("doi")), "missing_doi"), (~F.col("publication_year").between(1996, 2000), "year_out_of_range"), (F.col("citation_count").isNull(), "missing_citations"), (~present(F.col("authors")) & ~present(F.col("institutions")), "no_people")]
    return pub.withColumn("errors", F.array_compact(F.array(*(F.when(cond, name) for cond, name in rules))))


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return with_errors(publications(spark, folder, "publication_key", "doi", "publication_year", "citation_count", "authors", "institutions"))


@query("validation_errors", _ERRORS_SQL + ", x AS (SELECT unnest(errors) AS error FROM e) SELECT error, count(*) AS n FROM x GROUP BY error")
def validation_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("valid_split", _ERRORS_SQL + " SELECT len(errors) = 0 AS valid, count(*) AS n, min(publication_key) AS first_key FROM e GROUP BY ALL")
def valid_split(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).groupBy((F.size("errors") == 0).alias("valid")).agg(F.count("*").alias("n"), F.min("publication_key").alias("first_key"))


@query("missing_percent", PUB_SQL + """ SELECT 'doi' AS field, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(doi, '')) = '') AS missing FROM pub
UNION ALL SELECT 'citation_count', count(*), count(*) FILTER (WHERE citation_count IS NULL) FROM pub UNION ALL SELECT 'is_oa', count(*), count(*) FILTER (WHERE is_oa IS NULL) FROM pub
UNION ALL SELECT 'authors', count(*), count(*) FILTER (WHERE coalesce(authors, '') = '') FROM pub""")
def missing_percent(spark: SparkSession, folder: str) -> DataFrame:
    """Blank values of every field, in one aggregation."""
    names = ("doi", "citation_count", "is_oa", "authors")
    pub = publications(spark, folder, *names)
    row = pub.agg(F.count("*").alias("n"), *(F.count_if(~present(F.col(c))).alias(c) for c in names))
    return row.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in names))).alias("x")).select("x.field", "n", "x.missing")


@query("column_profile", """SELECT 'lang' AS name, count(*) AS n, count(DISTINCT lang) AS distinct_values, min(lang) AS least, max(lang) AS greatest FROM documents
UNION ALL SELECT 'source', count(*), count(DISTINCT source), min(source), max(source) FROM documents
UNION ALL SELECT 'n_chars', count(*), count(DISTINCT n_chars), min(CAST(n_chars AS VARCHAR)), max(CAST(n_chars AS VARCHAR)) FROM documents""")
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    names = ("lang", "source", "n_chars")
    docs = table(spark, folder, "documents")
    aggs = [a for c in names for a in (F.countDistinct(c).alias(f"{c}_d"), F.min(F.col(c).cast("string")).alias(f"{c}_l"), F.max(F.col(c).cast("string")).alias(f"{c}_g"))]
    row = docs.agg(F.count("*").alias("n"), *aggs)
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"{c}_d").alias("distinct_values"), F.col(f"{c}_l").alias("least"), F.col(f"{c}_g").alias("greatest")) for c in names))
    return row.select("n", F.explode(cells).alias("x")).select("x.name", "n", "x.distinct_values", "x.least", "x.greatest")


@query("source_coverage", """SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS long_texts, count(*) FILTER (WHERE lang = 'en') AS english, round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 2) AS english_percent FROM documents GROUP BY source""")
def source_coverage(spark: SparkSession, folder: str) -> DataFrame:
    english = F.count_if(F.col("lang") == "en")
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long_texts"), english.alias("english"), F.round(english * 100.0 / F.count("*"), 2).alias("english_percent"))


@query("column_pairs", PUB_SQL + """ SELECT count(*) FILTER (WHERE trim(coalesce(doi, '')) <> '' AND citation_count IS NOT NULL) AS both_present, count(*) FILTER (WHERE trim(coalesce(doi, '')) <> '' AND citation_count IS NULL) AS left_only,
  count(*) FILTER (WHERE trim(coalesce(doi, '')) = '' AND citation_count IS NOT NULL) AS right_only FROM pub""")
def column_pairs(spark: SparkSession, folder: str) -> DataFrame:
    a, b = present(F.col("doi")), F.col("citation_count").isNotNull()
    return publications(spark, folder, "doi", "citation_count").agg(F.count_if(a & b).alias("both_present"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"))


@query("field_gates", PUB_SQL + """, m AS (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(authors, '') <> '') AS a, count(*) FILTER (WHERE trim(coalesce(doi, '')) <> '') AS d, count(*) FILTER (WHERE citation_count < 0) AS c FROM pub)
SELECT 'authors_present' AS gate, a AS value, a >= 0.9 * n AS passed FROM m UNION ALL SELECT 'doi_present', d, d >= 0.9 * n FROM m UNION ALL SELECT 'negative_citations', c, c = 0 FROM m""")
def field_gates(spark: SparkSession, folder: str) -> DataFrame:
    m = publications(spark, folder, "authors", "doi", "citation_count").agg(F.count("*").alias("n"), F.count_if(present(F.col("authors"))).alias("a"), F.count_if(present(F.col("doi"))).alias("d"), F.count_if(F.col("citation_count") < 0).alias("c"))
    gates = [("authors_present", F.col("a"), F.col("a") >= F.col("n") * 0.9), ("doi_present", F.col("d"), F.col("d") >= F.col("n") * 0.9), ("negative_citations", F.col("c"), F.col("c") == 0)]
    return m.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), v.alias("value"), p.alias("passed")) for g, v, p in gates))).alias("x")).select("x.*")


@query("count_comparison", PUB_SQL + """, d AS (SELECT source_dataset, CASE WHEN trim(coalesce(doi, '')) <> '' THEN lower(trim(doi)) END AS doi, type FROM pub)
SELECT source_dataset, count(*) AS total, count(doi) AS with_doi, count(DISTINCT doi) AS unique_doi, CASE WHEN count(doi) >= 0.5 * count(*) THEN count(DISTINCT doi) + count(*) - count(doi) ELSE count(*) END AS estimated FROM d GROUP BY source_dataset""")
def count_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Unique publications of each source, estimated by DOI where at least half have one."""
    d = publications(spark, folder, "source_dataset", "doi").withColumn("d", F.when(present(F.col("doi")), F.lower(F.trim("doi"))))
    got = d.groupBy("source_dataset").agg(F.count("*").alias("total"), F.count("d").alias("with_doi"), F.countDistinct("d").alias("unique_doi"))
    return got.withColumn("estimated", F.when(F.col("with_doi") >= F.col("total") * 0.5, F.col("unique_doi") + F.col("total") - F.col("with_doi")).otherwise(F.col("total")))


@query("doi_conflicts", """WITH d AS (SELECT o_custkey AS doi, o_orderpriority AS title, year(o_orderdate) AS y FROM orders)
SELECT doi, count(*) AS n, count(DISTINCT title) AS titles, CAST(max(y) - min(y) AS INTEGER) AS year_span FROM d GROUP BY doi HAVING count(*) > 1 AND count(DISTINCT title) > 1""")
def doi_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers whose records contradict each other."""
    d = table(spark, folder, "orders").select(F.col("o_custkey").alias("doi"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("y"))
    return d.groupBy("doi").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"), (F.max("y") - F.min("y")).alias("year_span")).where("n > 1 AND titles > 1")


@query("release_check", """SELECT source AS value, count(*) AS n, count(DISTINCT text) AS distinct_texts, count(*) - count(DISTINCT text) AS repeats FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 25""")
def release_check(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("source", F.md5("text").alias("t"))
    got = docs.groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n"), F.countDistinct("t").alias("distinct_texts"))
    return got.withColumn("repeats", F.col("n") - F.col("distinct_texts")).orderBy(F.desc("n"), "value").limit(25)


@query("period_stats", """SELECT date_trunc('week', ts) AS week, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, median(value) AS median_value, stddev_samp(value) > 0 AS spread FROM events GROUP BY ALL""")
def period_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of each period, with the exact median."""
    e = table(spark, folder, "events").withColumn("week", F.date_trunc("week", "ts"))
    return e.groupBy("week", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.percentile("value", F.lit(0.5)).alias("median_value"), (F.stddev_samp("value") > 0).alias("spread"))


@query("drift_psi", """WITH w AS (SELECT date_trunc('week', ts) AS week, event_type FROM events), c AS (SELECT week, event_type, count(*) AS n FROM w GROUP BY ALL),
p AS (SELECT week, event_type, n, greatest(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY week), 0.0001) AS share FROM c),
b AS (SELECT DISTINCT week FROM c), k AS (SELECT DISTINCT event_type FROM c),
f AS (SELECT b.week, k.event_type, coalesce(p.share, 0.0001) AS share FROM b CROSS JOIN k LEFT JOIN p ON p.week = b.week AND p.event_type = k.event_type),
d AS (SELECT week, event_type, share, lag(share) OVER (PARTITION BY event_type ORDER BY week) AS before FROM f)
SELECT week, round(sum((share - before) * ln(share / before)), 9) AS psi, sum((share - before) * ln(share / before)) >= 0.15 AS alert FROM d WHERE before IS NOT NULL GROUP BY week""")
def drift_psi(spark: SparkSession, folder: str) -> DataFrame:
    """Population stability of event types from week to week; shares count as 0.0001 at least."""
    counts = table(spark, folder, "events").groupBy(F.date_trunc("week", "ts").alias("week"), "event_type").agg(F.count("*").alias("n"))
    weeks = counts.groupBy("week").agg(F.sum("n").alias("total")).withColumn("before", F.lag("week").over(Window.orderBy("week")))  # one row a week
    shares = counts.join(weeks, "week").select("week", "before", "event_type", F.greatest(F.col("n") / F.col("total"), F.lit(0.0001)).alias("share"))
    # types of neither week add nothing
    now = shares.where("before IS NOT NULL").select("week", "event_type", "share")
    was = shares.select(F.col("week").alias("before"), "event_type", F.col("share").alias("old")).join(weeks.select("week", "before"), "before").drop("before")
    both = now.join(was, ["week", "event_type"], "full").fillna(0.0001, ["share", "old"])
    psi = F.sum((F.col("share") - F.col("old")) * F.log(F.col("share") / F.col("old")))
    return both.groupBy("week").agg(psi.alias("psi")).select("week", F.round("psi", 9).alias("psi"), (F.col("psi") >= 0.15).alias("alert"))


@query("ops_dashboard", """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY ALL)
SELECT count(*) AS days, CAST(sum(n) AS BIGINT) AS events, CAST(sum(errors) AS BIGINT) AS errors, round(avg(n), 4) AS daily_mean, max(n) AS busiest FROM d""")
def ops_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "events").where("ts >= timestamp'2024-01-08'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return days.agg(F.count("*").alias("days"), F.sum("n").alias("events"), F.sum("errors").alias("errors"), F.round(F.avg("n"), 4).alias("daily_mean"), F.max("n").alias("busiest"))


@query("event_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def event_props(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("doi_check", PUB_SQL + " SELECT count(*) FILTER (WHERE regexp_full_match(trim(coalesce(doi, '')), '10\\.\\d{4,9}/[^\\s\"''<>]+')) AS valid, count(*) AS n FROM pub")
def doi_check(spark: SparkSession, folder: str) -> DataFrame:
    return publications(spark, folder, "doi").agg(F.count_if(is_doi(F.col("doi"))).alias("valid"), F.count("*").alias("n"))
