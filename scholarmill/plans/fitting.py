"""Fitted calibrators, and how good topics are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calibrate, classifiers, coherence, splits, text
from ..registry import query
from ..sources.tables import table

_SCORES = "WITH s AS (SELECT doc_id, CAST(quality AS INTEGER) AS y, round(CAST(doc_id * 7919 % 1000 AS DOUBLE) / 1000 * 0.6 + quality * 0.25, 3) AS score FROM labels WHERE quality IS NOT NULL)"


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score that knows something of the label."""
    score = F.round((F.col("doc_id") * 7919 % 1000).cast("double") / 1000 * 0.6 + F.col("quality") * 0.25, 3)
    return table(spark, folder, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y"), score.alias("score"))


_ISOTONIC_SQL = _SCORES + """, g AS (SELECT score, count(*) AS n, sum(y) AS p, row_number() OVER (ORDER BY score) AS i FROM s GROUP BY score),
c AS (SELECT i, score, sum(n) OVER (ORDER BY i) AS n, sum(p) OVER (ORDER BY i) AS p FROM g UNION ALL SELECT 0, NULL, 0, 0),
m AS (SELECT a.i + 1 AS a, b.i AS b, (b.p - a.p) / (b.n - a.n) AS mean FROM c a JOIN c b ON a.i < b.i),
least AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM m),
fit AS (SELECT score, max(v) AS value FROM least JOIN g USING (i) GROUP BY score)"""


@query("isotonic_calibration", _ISOTONIC_SQL + " SELECT doc_id, score, round(value, 9) AS calibrated FROM s JOIN fit USING (score)")
def isotonic_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Each score with its calibrated probability, by the rising step function nearest to the labels."""
    rows = _scores(spark, folder)
    fitted = calibrate.Isotonic.of(calibrate.isotonic(calibrate.by_score(rows, "score", "y")))
    return rows.select("doc_id", "score", F.round(fitted.column(F.col("score")), 9).alias("calibrated"))


@query("isotonic_blocks", _ISOTONIC_SQL + " SELECT min(score) AS lo, max(score) AS hi, CAST(sum(n) AS BIGINT) AS n, round(value, 9) AS value FROM fit JOIN g USING (score) GROUP BY value")
def isotonic_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The steps of the fit."""
    found = calibrate.isotonic(calibrate.by_score(_scores(spark, folder), "score", "y"))
    return found.select("lo", "hi", "n", F.round("value", 9).alias("value"))


@query("sigmoid_calibration", _SCORES.replace("WITH s", "WITH RECURSIVE s") + """, g AS (SELECT score AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS y FROM s GROUP BY score),
l AS (SELECT list(x ORDER BY x) AS xs, list(n ORDER BY x) AS ns, list(y ORDER BY x) AS ys, range(1, count(*) + 1) AS k FROM g),
fit AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b
  UNION ALL SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT step, a, b, a + list_sum(list_transform(k, lambda i: (ns[i] * p[i] - ys[i]) * xs[i])) AS ga, list_sum(list_transform(k, lambda i: ns[i] * p[i] - ys[i])) AS gb,
      1 + list_sum(list_transform(k, lambda i: ns[i] * p[i] * (1 - p[i]) * xs[i] * xs[i])) AS haa, list_sum(list_transform(k, lambda i: ns[i] * p[i] * (1 - p[i]) * xs[i])) AS hab, list_sum(list_transform(k, lambda i: ns[i] * p[i] * (1 - p[i]))) AS hbb
    FROM (SELECT step, a, b, xs, ns, ys, k, list_transform(k, lambda i: 1 / (1 + exp(-(xs[i] * a + b)))) AS p FROM fit, l WHERE step < 25)))
SELECT doc_id, round(1 / (1 + exp(-(score * a + b))), 6) AS calibrated FROM s, fit WHERE step = 25""")
def sigmoid_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Each score's probability by a logistic fit to the labels."""
    rows = _scores(spark, folder)
    fitted = calibrate.sigmoid(calibrate.by_score(rows, "score", "y"))
    return rows.select("doc_id", F.round(fitted.column(F.col("score")), 6).alias("calibrated"))


@query("calibration_metrics", _SCORES + """, b AS (SELECT greatest(CAST(ceil(score * 10) AS INTEGER) - 1, 0) AS b, sum(score) AS sc, sum(y) AS y, count(*) AS n FROM s GROUP BY ALL)
SELECT (SELECT count(*) FROM s) AS records, CAST((SELECT sum(y) FROM s) AS BIGINT) AS positives, CAST((SELECT count(*) - sum(y) FROM s) AS BIGINT) AS negatives, (SELECT round(avg((score - y) * (score - y)), 9) FROM s) AS brier_score,
  round(sum(abs(sc - y)) / sum(n), 9) AS expected_calibration_error, (SELECT round(avg(CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5 ELSE 0 END), 9) FROM s p, s q WHERE p.y = 1 AND q.y = 0) AS roc_auc FROM b""")
def calibration_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = calibrate.metrics(_scores(spark, folder), "score", "y")
    return found.select("records", "positives", "negatives", *(F.round(c, 9).alias(c) for c in ("brier_score", "expected_calibration_error", "roc_auc")))


def _topic_words(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as words, and the ten most frequent words of five letters or more of every language as its topic."""
    docs = table(spark, folder, "documents").select("lang", text.words(F.col("text")).alias("tokens"))
    counts = docs.select("lang", F.explode("tokens").alias("word")).where(F.length("word") >= 5).groupBy("lang", "word").agg(F.count("*").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return docs, counts.withColumn("k", F.row_number().over(best)).where("k <= 10").select(F.col("lang").alias("topic"), "word")


_WORDS_SQL = """WITH d AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS l FROM documents),
tw AS (SELECT lang AS topic, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM (SELECT lang, unnest(l) AS word FROM d) WHERE length(word) >= 5 GROUP BY lang, word) WHERE k <= 10)"""


@query("topic_coherence", _WORDS_SQL + """, o AS (SELECT doc_id, len(l) AS size, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS at_place FROM d),
q AS (SELECT DISTINCT doc_id, word, unnest(range(greatest(at_place - 109, 0), least(at_place, greatest(size - 110, 0)) + 1)) AS start FROM o WHERE word IN (SELECT word FROM tw)),
total AS (SELECT CAST(sum(greatest(len(l) - 110, 0) + 1) AS DOUBLE) AS n FROM d WHERE len(l) > 0),
one AS (SELECT word, count(*) AS c FROM q GROUP BY word),
two AS (SELECT a.word AS a, b.word AS b, count(*) AS c FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.start = b.start GROUP BY ALL),
v AS (
  SELECT x.topic, x.word AS a, y.word AS b, ln((coalesce(two.c, 0) / n + 1e-12) / (oa.c / n * ob.c / n)) / -ln(coalesce(two.c, 0) / n + 1e-12) AS v
  FROM tw x JOIN tw y ON x.topic = y.topic CROSS JOIN total JOIN one oa ON oa.word = x.word JOIN one ob ON ob.word = y.word LEFT JOIN two ON two.a = x.word AND two.b = y.word),
t AS (SELECT topic, b, sum(v) AS s FROM v GROUP BY ALL),
k AS (SELECT v.topic, v.a, sum(v.v * t.s) / (sqrt(sum(v.v * v.v)) * sqrt(sum(t.s * t.s))) AS cosine FROM v JOIN t ON t.topic = v.topic AND t.b = v.b GROUP BY ALL)
SELECT topic, round(avg(cosine), 6) AS coherence FROM k GROUP BY topic""")
def topic_coherence(spark: SparkSession, folder: str) -> DataFrame:
    """How well the words of each topic go together in windows of 110 words."""
    docs, words = _topic_words(spark, folder)
    return coherence.coherence_cv(docs, "tokens", words).select("topic", F.round("coherence", 6).alias("coherence"))


@query("topic_overlap", _WORDS_SQL + """, z AS (SELECT a.topic AS a, b.topic AS b, count(*) FILTER (WHERE a.word = b.word) AS c FROM tw a JOIN tw b ON a.topic < b.topic GROUP BY ALL)
SELECT round((SELECT count(DISTINCT word) / count(*) FROM tw), 9) AS diversity, (SELECT round(avg(c / (20 - c)), 9) FROM z) AS redundancy""")
def topic_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Diversity of the topics' words and the mean overlap of two topics."""
    words = _topic_words(spark, folder)[1]
    return coherence.diversity(words).crossJoin(coherence.redundancy(words)).select(F.round("diversity", 9).alias("diversity"), F.round("redundancy", 9).alias("redundancy"))  # one row each


@query("classifier_comparison")
def classifier_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Four models that tell language and quality of labelled documents, learned and compared on one split without leaks."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels").where("quality IS NOT NULL"), "doc_id")
    rows = docs.select("doc_id", "text", "lang", F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("label"), F.array(F.md5("text")).alias("tokens"))
    parts = splits.stratified_split(rows, "doc_id", "label", "tokens", (0.7, 0.1, 0.2), least=5)
    found = classifiers.predictions(parts.where("split = 'train'"), parts.where("split = 'test'"), "doc_id", "text", "label", "lang", rounds=8)
    return classifiers.comparison(found, "label")
