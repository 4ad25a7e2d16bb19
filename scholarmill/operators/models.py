"""Evaluation, calibration, sampling, trends, forecasts, topics and classifiers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.work import written


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from a confusion matrix; null over nothing."""
    both = F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("found"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("found"), F.lit(0).cast("long").alias("tp")))
    sums = matrix.select(F.explode(both).alias("x")).select("x.*").groupBy("label").agg(F.sum("support").alias("support"), F.sum("found").alias("found"), F.sum("tp").alias("tp"))

    def part(a: Column, b: Column) -> Column:
        return F.round(a / F.nullif(b, F.lit(0)), 6)

    return sums.select("label", "support", part(F.col("tp"), F.col("found")).alias("precision"), part(F.col("tp"), F.col("support")).alias("recall"), part(F.col("tp") * 2, F.col("found") + F.col("support")).alias("f1"))


def _bin(score: Column, bins: int) -> Column:
    return F.greatest(F.ceil(score * bins) - 1, F.lit(0))


def reliability(rows: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """(bin, n, positives, mean_score) for equal right-closed bins; empty bins stay."""
    got = rows.groupBy(_bin(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.round(F.sum(score) / F.count("*"), 6).alias("mean_score"))
    every = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"), "mean_score")


def calibration(rows: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """One row: expected calibration error and Brier score."""
    by_bin = rows.groupBy(_bin(F.col(score), bins).alias("b")).agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.avg(label).alias("y"), F.sum(F.pow(F.col(score) - F.col(label), 2)).alias("e"))
    return by_bin.agg(F.round(F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("e") / F.sum("n"), 6).alias("brier"))


def best_threshold(rows: DataFrame, score: str, label: str, precision: float, steps: int) -> DataFrame:
    """The threshold that takes most rows at a precision; scores are counted on a grid of ``steps`` first.

    The running sums are over the grid's few rows, whatever the number of scores.
    """
    grid = rows.groupBy(F.floor(F.col(score) * steps + 1e-9).alias("g")).agg(F.count("*").alias("n"), F.sum(label).alias("pos"), F.min(score).alias("threshold"))
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("g"))
    run = grid.select("threshold", F.sum("n").over(down).alias("taken"), F.sum("pos").over(down).alias("hits")).withColumn("precision", F.round(F.col("hits") / F.col("taken"), 6))
    return run.where(F.col("hits") / F.col("taken") >= precision).orderBy(F.desc("taken"), "threshold").limit(1)


def stratified(rows: DataFrame, strata: list[str], key: str, quota: int, seed: int = 0) -> DataFrame:
    """``quota`` rows of each stratum at most, by a seeded hash of the key.

    Each hash slot of a stratum gives its first rows before the strata are ranked, so that no stratum is sorted whole.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    spread = rows.withColumn("_h", h).withColumn("_s", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(64)))
    first = spread.withColumn("_k", F.row_number().over(Window.partitionBy(*strata, "_s").orderBy("_h", key))).where(F.col("_k") <= quota)
    return first.withColumn("_k", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key))).where(F.col("_k") <= quota).drop("_h", "_s", "_k")


def group_split(rows: DataFrame, group: str, parts: tuple[float, float, float], seed: int = 0) -> DataFrame:
    """Rows with ``split`` (train, validation, test): a group's rows share it, by a seeded hash."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(1_000_000)) / 1_000_000
    return rows.withColumn("split", F.when(at < parts[0], "train").when(at < parts[0] + parts[1], "validation").otherwise("test"))


def _tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _fraction(1 - x, b, a, front)
    return _fraction(x, a, b, front)


def _fraction(x: float, a: float, b: float, front: float) -> float:
    """front / a times the continued fraction, from the back."""
    value = 0.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1 + odd / (1 + value))
    first = -(a + b) * x / (a + 1)
    return front / a / (1 + first / (1 + value))


@F.pandas_udf(DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation over n points; null for fewer than three."""
    out = []
    for x, k in zip(r, n, strict=True):
        if k is None or k < 3 or x is None or x != x:
            out.append(None)
        else:
            out.append(0.0 if abs(x) >= 1 else _tail(x * math.sqrt((k - 2) / (1 - x * x)), int(k) - 2))
    return pd.Series(out, dtype="float64")


def classify_trends(slopes: DataFrame, alpha: float) -> DataFrame:
    found = slopes.withColumn("p", p_value("correlation", "periods"))
    sure = F.coalesce(F.col("p") < alpha, F.lit(False))
    return found.withColumn("trend", F.when(sure & (F.col("slope") > 0), "emerging").when(sure & (F.col("slope") < 0), "declining").otherwise("stable"))


def forecasts(series: DataFrame, test: int = 2, least: int = 6) -> DataFrame:
    """(topic, method, mae, rmse) over the last ``test`` periods, for topics with ``least`` periods or more."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("period")
        y, x = s.value.to_numpy(), s.period.to_numpy(dtype=float)
        rows = []
        if len(y) >= least:
            a, b, ahead = y[:-test], y[-test:], range(1, test + 1)
            slope = ((x[:-test] - x[:-test].mean()) * (a - a.mean())).sum() / ((x[:-test] - x[:-test].mean()) ** 2).sum()
            level, trend = a[0], a[1] - a[0]
            for v in a[1:]:
                old = level
                level = 0.5 * v + 0.5 * (level + trend)
                trend = 0.3 * (level - old) + 0.7 * trend
            guesses = {"naive": [a[-1]] * test, "linear": [a.mean() + slope * (t - x[:-test].mean()) for t in x[-test:]], "holt": [level + k * trend for k in ahead]}
            for name, g in guesses.items():
                e = b - pd.Series(g).to_numpy()
                rows.append((pdf.topic.iloc[0], name, float(abs(e).mean()), float((e**2).mean() ** 0.5)))
        return pd.DataFrame(rows, columns=["topic", "method", "mae", "rmse"])

    return series.groupBy("topic").applyInPandas(one, "topic string, method string, mae double, rmse double")


def topics(weights: DataFrame, doc: str, term: str, weight: str, k: int, rounds: int) -> DataFrame:
    """(doc, topic, strength): non-negative matrix factors by multiplicative updates, as joins and sums.

    Only the small term-by-topic and topic-by-topic sums are gathered; documents stay where they are.
    """
    rows = written(weights.select(F.col(doc).alias("d"), F.col(term).alias("t"), F.col(weight).alias("w")), "weights")
    start = [F.abs(F.sin(F.xxhash64("t", F.lit(j)).cast("double") % 1000)) + 0.1 for j in range(k)]
    terms = written(rows.select("t").distinct().select("t", F.array(*start).alias("h")), "terms")
    docs = written(rows.select("d").distinct().select("d", F.array(*(F.lit(1.0) for _ in range(k))).alias("g")), "docs")

    def step(own: DataFrame, other: DataFrame, key: str, okey: str, mine: str, its: str) -> DataFrame:
        gram = other.agg(*(F.sum(F.col(its)[i] * F.col(its)[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k))).first()
        met = rows.join(other, okey).groupBy(key).agg(*(F.sum(F.col("w") * F.col(its)[j]).alias(f"n{j}") for j in range(k)))
        joined = own.join(met, key)
        new = [F.col(mine)[j] * F.col(f"n{j}") / (sum((F.col(mine)[i] * F.lit(float(gram[f"g{i}_{j}"])) for i in range(k)), F.lit(1e-12))) for j in range(k)]
        return written(joined.select(key, F.array(*new).alias(mine)), "factors")

    for _ in range(rounds):
        docs = step(docs, terms, "d", "t", "g", "h")
        terms = step(terms, docs, "t", "d", "h", "g")
    best = F.array_max("g")
    return docs.select(F.col("d").alias(doc), (F.array_position("g", best) - 1).alias("topic"), best.alias("strength"))


def text_classifier(docs: DataFrame, labels: DataFrame, label: str, features: int = 1 << 14) -> DataFrame:
    """(doc_id, score, predicted) by logistic regression on hashed TF-IDF of words."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    known = docs.join(labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("label")), "doc_id")
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+", toLowercase=False), HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=10, regParam=0.01)]
    scored = Pipeline(stages=stages).fit(known).transform(docs)
    return scored.select("doc_id", vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("predicted"))
