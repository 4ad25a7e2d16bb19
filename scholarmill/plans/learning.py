"""Evaluation, calibration, topics and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import embeddings, models, text
from ..registry import query
from ..sources.tables import PUB_SQL, publications, table

_SCORED_SQL = "WITH s AS (SELECT l.doc_id, quality, toxic, CAST(l.doc_id * 7919 % 1000 AS DOUBLE) / 1000 AS score FROM labels l), p AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted FROM s)"


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    score = (F.col("doc_id") * 7919 % 1000).cast("double") / 1000
    return table(spark, folder, "labels").select("doc_id", "quality", "toxic", score.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query("confusion_matrix", _SCORED_SQL + " SELECT quality AS truth, predicted, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return models.confusion(_scored(spark, folder), "quality", "predicted")


@query("per_class_prf", _SCORED_SQL + """, c AS (SELECT quality AS t, predicted AS q, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT t AS label FROM c UNION SELECT q FROM c),
m AS (SELECT label, coalesce(sum(n) FILTER (WHERE t = label AND q = label), 0) AS tp, coalesce(sum(n) FILTER (WHERE t = label), 0) AS support, coalesce(sum(n) FILTER (WHERE q = label), 0) AS found FROM c, k GROUP BY label)
SELECT label, CAST(support AS BIGINT) AS support, round(tp / nullif(found, 0), 6) AS precision, round(tp / nullif(support, 0), 6) AS recall, round(2 * tp / nullif(found + support, 0), 6) AS f1 FROM m""")
def per_class_prf(spark: SparkSession, folder: str) -> DataFrame:
    return models.per_class(models.confusion(_scored(spark, folder), "quality", "predicted"))


@query("reliability_table", _SCORED_SQL + """, b AS (SELECT greatest(CAST(ceil(score * 10) AS INTEGER) - 1, 0) AS bin, score, quality FROM s)
SELECT r.bin, count(b.bin) AS n, CAST(coalesce(sum(quality), 0) AS BIGINT) AS positives, round(sum(score) / count(b.bin), 6) AS mean_score FROM (SELECT unnest(range(0, 10)) AS bin) r LEFT JOIN b ON r.bin = b.bin GROUP BY r.bin""")
def reliability_table(spark: SparkSession, folder: str) -> DataFrame:
    return models.reliability(_scored(spark, folder), "score", "quality", 10)


@query("calibration_error", _SCORED_SQL + """, b AS (SELECT greatest(CAST(ceil(score * 10) AS INTEGER) - 1, 0) AS bin, score, quality FROM s), g AS (SELECT bin, count(*) AS n, avg(score) AS ms, avg(quality) AS mq FROM b GROUP BY bin)
SELECT round(sum(n * abs(ms - mq)) / sum(n), 6) AS ece, (SELECT round(avg((score - quality) * (score - quality)), 6) FROM s) AS brier FROM g""")
def calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    return models.calibration(_scored(spark, folder), "score", "quality", 10)


@query("threshold_search", _SCORED_SQL + """, t AS (SELECT score, count(*) AS n, sum(quality) AS pos FROM s GROUP BY score), c AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS taken, sum(pos) OVER (ORDER BY score DESC) AS tp FROM t)
SELECT score AS threshold, CAST(taken AS BIGINT) AS taken, CAST(tp AS BIGINT) AS hits, round(tp / taken, 6) AS precision FROM c WHERE tp / taken >= 0.86 ORDER BY taken DESC, score LIMIT 1""")
def threshold_search(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold that takes most rows at a precision of 0.86 or more."""
    return models.best_threshold(_scored(spark, folder), "score", "quality", 0.86, 1000)


@query("score_labels", _SCORED_SQL + " SELECT CASE WHEN score >= 0.66 THEN 'AI' WHEN score < 0.4 THEN 'NON_AI' ELSE 'REVIEW' END AS label, CASE WHEN abs(score - 0.5) >= 0.4 THEN 'high' WHEN abs(score - 0.5) >= 0.2 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM s GROUP BY ALL")
def score_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by two thresholds, and bands of confidence."""
    s = F.col("score")
    label = F.when(s >= 0.66, "AI").when(s < 0.4, "NON_AI").otherwise("REVIEW")
    band = F.when(F.abs(s - 0.5) >= 0.4, "high").when(F.abs(s - 0.5) >= 0.2, "medium").otherwise("low")
    return _scored(spark, folder).groupBy(label.alias("label"), band.alias("band")).agg(F.count("*").alias("n"))


@query("annotation_agreement", _SCORED_SQL + """, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = predicted) AS same, avg(quality) AS pa, avg(predicted) AS pb FROM p)
SELECT n, same, round((CAST(same AS DOUBLE) / n - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM a""")
def annotation_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Two annotators' agreement, beyond chance."""
    a = _scored(spark, folder).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("predicted")).alias("same"), F.avg("quality").alias("pa"), F.avg("predicted").alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return a.select("n", "same", F.round((F.col("same") / F.col("n") - chance) / (1 - chance), 6).alias("kappa"))


@query("hard_negatives", _SCORED_SQL + " SELECT doc_id, score FROM s WHERE score >= 0.66 AND quality = 0")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """What the model takes and people reject."""
    return _scored(spark, folder).where("score >= 0.66 AND quality = 0").select("doc_id", "score")


@query("review_priority", _SCORED_SQL + ", r AS (SELECT doc_id, CAST(round(1000 * (1 - 2 * abs(score - 0.5) + CASE WHEN quality <> predicted THEN 1 ELSE 0 END), 0) AS BIGINT) AS priority FROM p) SELECT doc_id, priority FROM r ORDER BY priority DESC, doc_id LIMIT 25")
def review_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The rows most worth a reviewer's time: uncertain or contradicted."""
    worth = 1 - 2 * F.abs(F.col("score") - 0.5) + F.when(F.col("quality") != F.col("predicted"), 1).otherwise(0)
    return _scored(spark, folder).select("doc_id", F.round(worth * 1000, 0).cast("long").alias("priority")).orderBy(F.desc("priority"), "doc_id").limit(25)


@query("stratified_sample")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty rows of each stratum, by a hash of their ids."""
    return models.stratified(table(spark, folder, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 20)


@query("split_counts")
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Training, validation and test rows: copies of a text stay together."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.md5("text").alias("group_key"))
    return models.group_split(docs, "group_key", (0.8, 0.1, 0.1)).groupBy("lang", "split").agg(F.count("*").alias("n"))


_TOPIC_SQL = PUB_SQL + """, t AS (SELECT publication_year, trim(unnest(string_split(topics, ';'))) AS topic FROM pub), c AS (SELECT publication_year, topic, count(*) AS n FROM t WHERE topic <> '' GROUP BY ALL),
sh AS (SELECT publication_year, topic, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY publication_year) AS share FROM c)"""


def _topic_years(spark: SparkSession, folder: str) -> DataFrame:
    pub = publications(spark, folder, "publication_year", "topics").select("publication_year", F.explode(F.split("topics", r"\s*;\s*")).alias("topic")).where("topic <> ''")
    return text.shares(pub.groupBy("publication_year", "topic").agg(F.count("*").alias("n")), "publication_year", "topic")


@query("topic_share_by_year", _TOPIC_SQL + " SELECT publication_year, topic, n, round(share, 9) AS share FROM sh")
def topic_share_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return _topic_years(spark, folder).select("publication_year", "topic", "n", F.round("share", 9).alias("share"))


@query("topic_slope", _TOPIC_SQL + " SELECT topic, round(regr_slope(share, publication_year), 9) AS slope, count(*) AS periods FROM sh GROUP BY topic")
def topic_slope(spark: SparkSession, folder: str) -> DataFrame:
    return text.slopes(_topic_years(spark, folder), "topic", "publication_year", "share").select("topic", F.round("slope", 9).alias("slope"), "periods")


@query("topic_trends")
def topic_trends(spark: SparkSession, folder: str) -> DataFrame:
    """Topics as emerging, declining or stable, by the p-value of their slope."""
    return models.classify_trends(text.slopes(_topic_years(spark, folder), "topic", "publication_year", "share"), 0.10)


@query("topic_forecast")
def topic_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Naive, linear and Holt forecasts of every topic's last two years, with their errors."""
    return models.forecasts(_topic_years(spark, folder).select("topic", F.col("publication_year").alias("period"), F.col("share").alias("value")))


@query("topic_model")
def topic_model(spark: SparkSession, folder: str) -> DataFrame:
    """Non-negative factors of the documents' TF-IDF weights: each document's strongest topic."""
    weights = text.tfidf(table(spark, folder, "documents"), "doc_id", "text", least=5, most=0.5, features=300, top=None)
    return models.topics(weights, "doc_id", "term", "weight", k=8, rounds=6)


@query("topic_diversity", _TOPIC_SQL + ", r AS (SELECT publication_year, topic FROM sh QUALIFY row_number() OVER (PARTITION BY publication_year ORDER BY n DESC, topic) <= 3) SELECT count(DISTINCT topic) AS distinct_topics, count(*) AS listed FROM r")
def topic_diversity(spark: SparkSession, folder: str) -> DataFrame:
    best = Window.partitionBy("publication_year").orderBy(F.desc("n"), "topic")
    return _topic_years(spark, folder).withColumn("k", F.row_number().over(best)).where("k <= 3").agg(F.countDistinct("topic").alias("distinct_topics"), F.count("*").alias("listed"))


@query("classifier_scores")
def classifier_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Documents scored by a logistic regression on hashed TF-IDF features, learned from the labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return models.text_classifier(docs, table(spark, folder, "labels"), "quality")


def _embedded(spark: SparkSession, folder: str) -> tuple[embeddings.TextEmbedding, DataFrame]:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return embeddings.fit_text(docs, "doc_id", "text", least=5, most=0.8, features=2000, rank=32), docs


@query("text_embeddings")
def text_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as 32 dimensions of unit length, from a truncated decomposition of their TF-IDF weights."""
    fitted, docs = _embedded(spark, folder)
    return fitted.embed(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("semantic_search")
def semantic_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents nearest to a query's embedding."""
    fitted, docs = _embedded(spark, folder)
    asked = spark.createDataFrame([(0, "the station of nations with information and relations")], "id long, text string")
    vector = fitted.embed(asked, "id", "text").first()
    if vector is None:
        return fitted.embed(docs.limit(0), "doc_id", "text").select(F.col("id").alias("doc_id"), F.lit(0.0).alias("score"))
    found = fitted.embed(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")
    return text.search_by_vector(found, "doc_id", "embedding", list(vector.embedding), 10).select("doc_id", "score")
