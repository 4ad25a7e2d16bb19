"""Search: prefix terms, suggestions, TF-IDF terms, vector neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import looks_like_institution, tagged
from ..operators import text
from ..registry import query
from ..sources.tables import PUB_SQL, publications, table


@query("search_prefix", """
WITH d AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS words FROM documents)
SELECT doc_id, lang, len(list_filter(words, lambda w: starts_with(w, 'tion') OR starts_with(w, 'the'))) AS hits
FROM d WHERE len(list_filter(words, lambda w: starts_with(w, 'tion'))) > 0 AND len(list_filter(words, lambda w: starts_with(w, 'the'))) > 0
""")
def search_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which every term begins some word; ranked by the number of words that terms begin."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return text.prefix_search(docs, "text", ["tion", "the"]).select("doc_id", "lang", "hits")


@query("search_page", """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS words FROM documents)
SELECT doc_id, len(list_filter(words, lambda w: starts_with(w, 'ver'))) AS hits FROM d WHERE len(list_filter(words, lambda w: starts_with(w, 'ver'))) > 0
ORDER BY hits DESC, doc_id LIMIT 20
""")
def search_page(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return text.prefix_search(docs, "text", ["ver"]).select("doc_id", "hits").orderBy(F.desc("hits"), "doc_id").limit(20)


@query("suggest", PUB_SQL + """, named AS (
  SELECT DISTINCT 'author' AS kind, trim(unnest(string_split(authors, ';'))) AS value FROM pub
  UNION SELECT 'institution', trim(unnest(string_split(institutions, ';'))) FROM pub
  UNION SELECT 'topic', trim(unnest(string_split(topics, ';'))) FROM pub
  UNION SELECT 'publication', title FROM pub)
SELECT kind, value FROM named WHERE value ILIKE '%1%' AND value ILIKE '%0%' QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value) <= 4""")
def suggest(spark: SparkSession, folder: str) -> DataFrame:
    """At most four values of each kind that contain every term of the input."""
    pub = publications(spark, folder, "title", "authors", "institutions", "topics")
    kinds = [tagged(F.col(c), k, "kind", "value") for k, c in (("author", "authors"), ("institution", "institutions"), ("topic", "topics"))]
    rows = pub.select(F.explode(F.concat(*kinds, F.array(F.struct(F.lit("publication").alias("kind"), F.col("title").alias("value"))))).alias("x")).select("x.*")
    rows = rows.where(F.col("value").ilike("%1%") & F.col("value").ilike("%0%") & ~((F.col("kind") == "author") & looks_like_institution(F.col("value")))).distinct()
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("value"))).where("k <= 4").drop("k")


_TERMS = """
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE len(term) >= 2 GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 5 AND count(*) <= (SELECT floor(0.8 * n) FROM n) ORDER BY total DESC, df DESC, term LIMIT 2000)
"""


@query("tfidf_vocabulary", _TERMS + "SELECT term, df, CAST(total AS BIGINT) AS total FROM v")
def tfidf_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return text.vocabulary(table(spark, folder, "documents"), "text", 5, 0.8, 2000)[0]


@query("tfidf_top_terms", _TERMS + """, x AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN v USING (term)),
r AS (SELECT doc_id, term, w, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS k FROM x)
SELECT doc_id, term, k AS rank FROM r WHERE k <= 5""")
def tfidf_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return text.tfidf(docs, "doc_id", "text", least=5, most=0.8, features=2000, top=5).select("doc_id", "term", "rank")


@query("tfidf_weights", _TERMS + """, x AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN v USING (term)),
s AS (SELECT doc_id, term, w, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS k FROM x)
SELECT doc_id, term, CAST(round(1000 * w / l + 0.0001, 0) AS BIGINT) AS weight FROM s WHERE k <= 3""")
def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = text.tfidf(docs, "doc_id", "text", least=5, most=0.8, features=2000, top=3)
    return found.select("doc_id", "term", F.round(F.col("weight") * 1000 + 0.0001, 0).cast("long").alias("weight"))


_DOT = "list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)))"


@query("vector_topk", f"SELECT b.vec_id, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY round({_DOT}, 6) DESC, b.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of one stored vector, by dot product."""
    return text.related(table(spark, folder, "embeddings"), "vec_id", "embedding", 7, 10).select("vec_id", "score")


@query("vector_search_filtered", f"SELECT b.vec_id, b.label, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 11 AND b.vec_id <> 11 AND b.label IN (1, 2, 3) AND {_DOT} >= 0.1 ORDER BY round({_DOT}, 6) DESC, b.vec_id LIMIT 15")
def vector_search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where("label IN (1, 2, 3) OR vec_id = 11")
    return text.related(rows, "vec_id", "embedding", 11, 15, least=0.1).select("vec_id", "label", "score")


@query("vector_centroids", "SELECT label, count(*) AS n, count(DISTINCT len(embedding)) AS sizes FROM embeddings GROUP BY label")
def vector_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct(F.size("embedding")).alias("sizes"))
