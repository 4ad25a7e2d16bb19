"""Overview, lists, facets, rankings, trends and quality of publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import looks_like_institution, present, quality_flags, split_list, tagged
from ..operators.filters import where
from ..registry import query
from ..sources.tables import PUB_SQL, publications


def share(part, whole, digits: int = 4):
    """A ratio of counts, rounded; null over nothing."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


@query("analytics_overview", PUB_SQL + """
SELECT count(*) AS publications, CAST(sum(coalesce(citation_count, 0)) AS BIGINT) AS citations,
  count(*) FILTER (WHERE is_oa IS TRUE) AS open_access, count(*) FILTER (WHERE trim(coalesce(doi, '')) <> '') AS with_doi,
  round(sum(coalesce(citation_count, 0)) / nullif(count(*), 0), 2) AS mean_citations,
  round(count(*) FILTER (WHERE is_oa IS TRUE) / nullif(count(*), 0), 4) AS open_access_share,
  round(count(*) FILTER (WHERE trim(coalesce(doi, '')) <> '') / nullif(count(*), 0), 4) AS doi_share,
  min(publication_year) AS first_year, max(publication_year) AS last_year
FROM pub WHERE publication_year BETWEEN 1996 AND 2001
""")
def analytics_overview(spark: SparkSession, folder: str) -> DataFrame:
    pub = publications(spark, folder, "publication_year", "citation_count", "is_oa", "doi").where(where({"year_min": 1996, "year_max": 2001}))
    cited, n, oa, doi = F.sum(F.coalesce("citation_count", F.lit(0))), F.count("*"), F.count_if(F.col("is_oa").eqNullSafe(True)), F.count_if(present(F.col("doi")))
    return pub.agg(n.alias("publications"), cited.alias("citations"), oa.alias("open_access"), doi.alias("with_doi"), share(cited, n, 2).alias("mean_citations"), share(oa, n).alias("open_access_share"), share(doi, n).alias("doi_share"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"))


_PAGE = "publication_key, title, publication_year, type, citation_count, doi"
#: Sort orders: the column and the direction; unknown values come last, the key settles ties.
ORDERS = {
    "year_desc": ("publication_year", "DESC"),
    "year_asc": ("publication_year", "ASC"),
    "citations_desc": ("citation_count", "DESC"),
    "title_asc": ("title", "ASC"),
}


def ordered(rows: DataFrame, order: str) -> DataFrame:
    column, direction = ORDERS[order]
    first = F.desc_nulls_last(column) if direction == "DESC" else F.asc_nulls_last(column)
    return rows.orderBy(first, F.asc("publication_key"))


def _page(order: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        pub = publications(spark, folder, *_PAGE.split(", "), "is_oa").where(where({"is_oa": True, "type": ["1-URGENT", "2-HIGH"]}))
        return ordered(pub, order).offset(40).limit(20).select(*_PAGE.split(", "))

    return run


for _name, (_column, _direction) in ORDERS.items():
    query(f"publications_page_{_name}", f"{PUB_SQL} SELECT {_PAGE} FROM pub WHERE is_oa IS TRUE AND type IN ('1-URGENT', '2-HIGH') ORDER BY {_column} {_direction} NULLS LAST, publication_key LIMIT 20 OFFSET 40")(_page(_name))


@query("facets", PUB_SQL + """,
named AS (
  SELECT 'type' AS facet, type AS value FROM pub UNION ALL SELECT 'primary_field', primary_field FROM pub
  UNION ALL SELECT 'publication_year', CAST(publication_year AS VARCHAR) FROM pub
  UNION ALL SELECT 'is_oa', CASE WHEN is_oa THEN 'True' WHEN NOT is_oa THEN 'False' END FROM pub
  UNION ALL SELECT 'institutions', trim(unnest(string_split(institutions, ';'))) FROM pub
  UNION ALL SELECT 'countries', trim(unnest(string_split(countries, ';'))) FROM pub
  UNION ALL SELECT 'topics', trim(unnest(string_split(topics, ';'))) FROM pub
  UNION ALL SELECT 'source_dataset', trim(unnest(string_split(source_dataset, ';'))) FROM pub),
counted AS (SELECT facet, value, count(*) AS n FROM named WHERE trim(coalesce(value, '')) <> '' GROUP BY ALL)
SELECT facet, value, n FROM counted QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 25
""")
def facets(spark: SparkSession, folder: str) -> DataFrame:
    """All facets in one pass: every publication gives its (facet, value) pairs."""
    pub = publications(spark, folder, "type", "primary_field", "publication_year", "is_oa", "institutions", "countries", "topics", "source_dataset")
    oa = F.when(F.col("is_oa"), "True").when(~F.col("is_oa"), "False")
    single = [F.array(F.struct(F.lit(n).alias("facet"), c.alias("value"))) for n, c in (("type", F.col("type")), ("primary_field", F.col("primary_field")), ("publication_year", F.col("publication_year").cast("string")), ("is_oa", oa))]
    many = [tagged(F.col(n), n, "facet", "value") for n in ("institutions", "countries", "topics", "source_dataset")]
    counted = pub.select(F.explode(F.concat(*single, *many)).alias("x")).select("x.*").where(present(F.col("value"))).groupBy("facet", "value").agg(F.count("*").alias("n"))
    best = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counted.withColumn("k", F.row_number().over(best)).where("k <= 25").drop("k")


def rankings(pub: DataFrame, column: str, many: bool, least: int, size: int, offset: int = 0) -> DataFrame:
    """(label, n, citations, total) by how often a label occurs; ``total`` counts the labels with ``least`` or more."""
    label = F.explode(split_list(F.col(column))) if many else F.col(column)
    rows = pub.select(label.alias("label"), F.coalesce("citation_count", F.lit(0)).alias("c")).where(present(F.col("label")))
    if column == "authors":
        rows = rows.where(~looks_like_institution(F.col("label")))
    counted = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("c").alias("citations")).where(F.col("n") >= least)
    total = counted.agg(F.count("*").alias("total"))
    return counted.orderBy(F.desc("n"), "label").offset(offset).limit(size).crossJoin(F.broadcast(total))  # the total is one row


def _ranking_sql(column: str, many: bool, least: int) -> str:
    label = f"trim(unnest(string_split({column}, ';')))" if many else column
    return f"""{PUB_SQL}, named AS (SELECT {label} AS label, coalesce(citation_count, 0) AS c FROM pub)
SELECT label, count(*) AS n, CAST(sum(c) AS BIGINT) AS citations, count(*) OVER () AS total FROM named WHERE trim(coalesce(label, '')) <> ''
GROUP BY label HAVING count(*) >= {least} ORDER BY n DESC, label LIMIT 25"""


for _name, _column, _many, _least in (("authors", "authors", True, 5), ("institutions", "institutions", True, 1), ("field", "primary_field", False, 1), ("topics", "topics", True, 1), ("countries", "countries", True, 1)):
    query(f"rankings_{_name}", _ranking_sql(_column, _many, _least))(lambda spark, folder, c=_column, m=_many, k=_least: rankings(publications(spark, folder, c, "citation_count"), c, m, k, 25))


def trends(pub: DataFrame, column: str, many: bool) -> DataFrame:
    """(label, n, citations) for every value of a column."""
    label = F.explode(split_list(F.col(column))) if many else F.col(column)
    rows = pub.select(label.alias("label"), F.coalesce("citation_count", F.lit(0)).alias("c")).where(F.col("label").isNotNull())
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("c").alias("citations"))


for _name, _column, _many in (("year", "publication_year", False), ("type", "type", False), ("field", "primary_field", False), ("institution", "institutions", True)):
    _label = f"trim(unnest(string_split({_column}, ';')))" if _many else _column
    query(f"trends_{_name}", f"{PUB_SQL}, named AS (SELECT {_label} AS label, coalesce(citation_count, 0) AS c FROM pub) SELECT label, count(*) AS n, CAST(sum(c) AS BIGINT) AS citations FROM named WHERE label IS NOT NULL GROUP BY label")(
        lambda spark, folder, c=_column, m=_many: trends(publications(spark, folder, c, "citation_count"), c, m)
    )

_FLAGS_SQL = PUB_SQL + """, flags AS (
  SELECT *, unnest(list_filter([
    CASE WHEN trim(coalesce(doi, '')) = '' THEN 'missing_doi' END, CASE WHEN publication_year IS NULL THEN 'missing_year' END,
    CASE WHEN citation_count IS NULL THEN 'missing_citations' END, CASE WHEN is_oa IS NULL THEN 'unknown_open_access' END,
    CASE WHEN trim(coalesce(authors, '')) = '' THEN 'missing_authors' END, CASE WHEN trim(coalesce(institutions, '')) = '' THEN 'missing_institutions' END,
    CASE WHEN trim(coalesce(topics, '')) = '' THEN 'missing_topics' END, CASE WHEN contains(source_dataset, ';') THEN 'multiple_sources' END],
    lambda x: x IS NOT NULL)) AS flag FROM pub)
"""


def _flagged(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    names = ("doi", "publication_year", "citation_count", "is_oa", "authors", "institutions", "topics", "source_dataset")
    pub = publications(spark, folder, *dict.fromkeys((*names, *more)))
    return pub.withColumn("flags", quality_flags(*(F.col(c) for c in names)))


@query("quality_flags", _FLAGS_SQL + "SELECT flag, count(*) AS n FROM flags GROUP BY flag")
def quality_flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _flagged(spark, folder).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("data_quality", PUB_SQL + """SELECT primary_field, count(*) AS n,
  count(*) FILTER (WHERE trim(coalesce(doi, '')) = '') AS no_doi, count(*) FILTER (WHERE citation_count IS NULL) AS no_citations,
  count(*) FILTER (WHERE is_oa IS NULL) AS no_oa, count(*) FILTER (WHERE trim(coalesce(authors, '')) = '') AS no_authors,
  round(100.0 * count(*) FILTER (WHERE trim(coalesce(doi, '')) = '') / count(*), 2) AS no_doi_percent
FROM pub GROUP BY primary_field""")
def data_quality(spark: SparkSession, folder: str) -> DataFrame:
    pub = publications(spark, folder, "primary_field", "doi", "citation_count", "is_oa", "authors")
    no_doi, n = F.count_if(~present(F.col("doi"))), F.count("*")
    return pub.groupBy("primary_field").agg(n.alias("n"), no_doi.alias("no_doi"), F.count_if(F.col("citation_count").isNull()).alias("no_citations"), F.count_if(F.col("is_oa").isNull()).alias("no_oa"), F.count_if(~present(F.col("authors"))).alias("no_authors"), F.round(no_doi * 100.0 / n, 2).alias("no_doi_percent"))


@query("distinct_values", PUB_SQL + """SELECT 'authors' AS name, count(DISTINCT trim(v)) AS n FROM (SELECT unnest(string_split(authors, ';')) AS v FROM pub) WHERE trim(v) <> ''
UNION ALL SELECT 'institutions', count(DISTINCT trim(v)) FROM (SELECT unnest(string_split(institutions, ';')) AS v FROM pub) WHERE trim(v) <> ''
UNION ALL SELECT 'topics', count(DISTINCT trim(v)) FROM (SELECT unnest(string_split(topics, ';')) AS v FROM pub) WHERE trim(v) <> ''""")
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    pub = publications(spark, folder, "authors", "institutions", "topics")
    pairs = F.concat(*(tagged(F.col(c), c) for c in pub.columns))
    return pub.select(F.explode(pairs).alias("x")).select("x.*").groupBy("name").agg(F.countDistinct("v").alias("n"))


@query("metadata", PUB_SQL + "SELECT count(*) AS n, min(publication_year) AS first_year, max(publication_year) AS last_year, max(publication_date) AS last_date FROM pub")
def metadata(spark: SparkSession, folder: str) -> DataFrame:
    pub = publications(spark, folder, "publication_year", "publication_date")
    return pub.agg(F.count("*").alias("n"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"), F.max("publication_date").alias("last_date"))


def profile(pub: DataFrame, column: str, name: str) -> DataFrame:
    """Figures of the publications that list a name (whole item) in a multi-value column."""
    own = pub.where(F.array_contains(split_list(F.col(column)), name))
    cited = F.coalesce("citation_count", F.lit(0))
    return own.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(cited).alias("citations"), share(F.sum(cited), F.count("*"), 2).alias("mean_citations"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"))


@query("compare_institutions", PUB_SQL + """SELECT name, count(*) AS n, CAST(sum(coalesce(citation_count, 0)) AS BIGINT) AS citations,
  round(sum(coalesce(citation_count, 0)) / count(*), 2) AS mean_citations, min(publication_year) AS first_year, max(publication_year) AS last_year
FROM pub JOIN (VALUES ('NATION_1'), ('NATION_2'), ('NATION_3')) v(name) ON list_contains(string_split(institutions, '; '), name) GROUP BY name""")
def compare_institutions(spark: SparkSession, folder: str) -> DataFrame:
    """Two or three institutions side by side, in one pass."""
    names = F.array(*(F.lit(n) for n in ("NATION_1", "NATION_2", "NATION_3")))
    pub = publications(spark, folder, "institutions", "citation_count", "publication_year")
    own = pub.select(F.explode(F.array_intersect(split_list(F.col("institutions")), names)).alias("name"), F.coalesce("citation_count", F.lit(0)).alias("c"), "publication_year")
    return own.groupBy("name").agg(F.count("*").alias("n"), F.sum("c").alias("citations"), share(F.sum("c"), F.count("*"), 2).alias("mean_citations"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"))


@query("researcher_profile", PUB_SQL + """SELECT 'Supplier#000000003' AS name, count(*) AS n, CAST(sum(coalesce(citation_count, 0)) AS BIGINT) AS citations,
  round(sum(coalesce(citation_count, 0)) / nullif(count(*), 0), 2) AS mean_citations, min(publication_year) AS first_year, max(publication_year) AS last_year
FROM pub WHERE list_contains(string_split(authors, '; '), 'Supplier#000000003')""")
def researcher_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile(publications(spark, folder, "authors", "citation_count", "publication_year"), "authors", "Supplier#000000003")


@query("framework_counts", PUB_SQL + """, named AS (
  SELECT 'publication_year' AS field, CAST(publication_year AS VARCHAR) AS value, citation_count FROM pub UNION ALL SELECT 'type', type, citation_count FROM pub
  UNION ALL SELECT 'primary_field', primary_field, citation_count FROM pub UNION ALL SELECT 'source_dataset', source_dataset, citation_count FROM pub)
SELECT field, value, count(*) AS n, count(citation_count) AS with_citations FROM named WHERE value IS NOT NULL GROUP BY ALL""")
def framework_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by every field that has any value, in one pass."""
    names = ("publication_year", "type", "primary_field", "source_dataset")
    pub = publications(spark, folder, *names, "citation_count")
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names))
    return pub.select(F.explode(pairs).alias("x"), "citation_count").select("x.*", "citation_count").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"), F.count("citation_count").alias("with_citations"))


@query("top_cited_per_type", PUB_SQL + "SELECT type, publication_key, citation_count FROM pub WHERE citation_count IS NOT NULL QUALIFY row_number() OVER (PARTITION BY type ORDER BY citation_count DESC, publication_key) <= 4")
def top_cited_per_type(spark: SparkSession, folder: str) -> DataFrame:
    pub = publications(spark, folder, "type", "publication_key", "citation_count").where("citation_count IS NOT NULL")
    return pub.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("citation_count"), "publication_key"))).where("k <= 4").drop("k")


@query("dominant_field_by_year", PUB_SQL + ", n AS (SELECT publication_year, primary_field, count(*) AS n FROM pub GROUP BY ALL) SELECT publication_year, primary_field, n FROM n QUALIFY row_number() OVER (PARTITION BY publication_year ORDER BY n DESC, primary_field) = 1")
def dominant_field_by_year(spark: SparkSession, folder: str) -> DataFrame:
    counted = publications(spark, folder, "publication_year", "primary_field").groupBy("publication_year", "primary_field").agg(F.count("*").alias("n"))
    best = counted.groupBy("publication_year").agg(F.min_by(F.struct("primary_field", "n"), F.struct(-F.col("n"), "primary_field")).alias("b"))
    return best.select("publication_year", "b.primary_field", "b.n")
