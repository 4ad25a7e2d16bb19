"""Text classifiers learned on one split and compared on the other: logistic, naive Bayes, linear and two-level SVM."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import written
from .text import words

#: Names of the models, in the order in which they are compared.
MODELS = ("logistic_regression", "multinomial_nb", "linear_svm", "hierarchical_svm")


@dataclass
class Labels:
    """The classes of a column, in order; their number is that of the classes, not of rows."""

    names: list[str] = field(default_factory=list)

    @staticmethod
    def of(rows: DataFrame, column: str) -> Labels:
        return Labels(sorted(r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().collect()))

    def number(self, column: str) -> Column:
        return (F.array_position(F.array(*(F.lit(n) for n in self.names)), F.col(column)) - 1).cast("double")

    def name(self, column: str) -> Column:
        return F.get(F.array(*(F.lit(n) for n in self.names)), F.col(column).cast("int"))


def _one_against_rest(rounds: int) -> OneVsRest:
    return OneVsRest(classifier=LinearSVC(maxIter=rounds, regParam=0.01), featuresCol="features", labelCol="y", predictionCol="p")


def _fit(model, rows: DataFrame, label: str) -> tuple[Model | None, Labels]:
    """A fitted model, or none for a single class, with its classes."""
    labels = Labels.of(rows, label)
    if len(labels.names) < 2:
        return None, labels
    return model.fit(rows.withColumn("y", labels.number(label))), labels


def _predict(fitted: tuple[Model | None, Labels], rows: DataFrame, name: str) -> DataFrame:
    model, labels = fitted
    if model is None:
        return rows.withColumn(name, F.lit(labels.names[0]) if labels.names else F.lit(None).cast("string"))
    found = model.transform(rows)
    return found.select(*rows.columns, labels.name("p").alias(name))


def features(size: int = 1 << 15) -> Pipeline:
    """The stages from words to weights; they are fitted on what is learned from only."""
    return Pipeline(stages=[HashingTF(inputCol="words", outputCol="counts", numFeatures=size), IDF(inputCol="counts", outputCol="features", minDocFreq=2)])


def predictions(train: DataFrame, test: DataFrame, id_col: str, text_col: str, label: str, parent: str, size: int = 1 << 15, rounds: int = 20) -> DataFrame:
    """(id, label, model, predicted) of the test rows by each of the models.

    ``parent`` is the column of coarse classes: the two-level model first decides it, then the label among the labels of
    that class. A class with one label needs no second decision. Null texts have no words.
    """
    shown = lambda df: df.select(id_col, label, parent, words(F.col(text_col)).alias("words")).where(F.col(label).isNotNull() & F.col(parent).isNotNull())
    prepared = features(size).fit(shown(train))
    learn, ask = (written(prepared.transform(shown(df)).drop("words"), "classifier-rows") for df in (train, test))
    out = []
    plain = {
        "logistic_regression": LogisticRegression(maxIter=rounds, regParam=0.01, featuresCol="features", labelCol="y", predictionCol="p"),
        "multinomial_nb": NaiveBayes(smoothing=1.0, modelType="multinomial", featuresCol="counts", labelCol="y", predictionCol="p"),
        "linear_svm": _one_against_rest(rounds),
    }
    for name, model in plain.items():
        out.append(_predict(_fit(model, learn, label), ask, "predicted").select(id_col, label, F.lit(name).alias("model"), "predicted"))
    first = _fit(_one_against_rest(rounds), learn, parent)
    coarse = written(_predict(first, ask, "coarse"), "coarse-classes")
    for c in first[1].names:
        own = _fit(_one_against_rest(rounds), learn.where(F.col(parent) == c), label)
        found = _predict(own, coarse.where(F.col("coarse") == c), "predicted")
        out.append(found.select(id_col, label, F.lit("hierarchical_svm").alias("model"), "predicted"))
    every = out[0]
    for df in out[1:]:
        every = every.unionAll(df)
    return every


def comparison(found: DataFrame, label: str) -> DataFrame:
    """A row for each model: rows, accuracy, macro precision, recall and F1, and F1 weighted by support.

    Classes that a model never predicts, or that have no rows, count with 0.
    """
    cells = found.groupBy("model", F.col(label).alias("truth"), "predicted").agg(F.count("*").alias("n"))
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    ends = F.array(F.struct(F.col("truth").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given"), hit.alias("tp")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given"), F.lit(0).cast("long").alias("tp")))
    by_class = cells.select("model", F.explode(ends).alias("x")).select("model", "x.*").groupBy("model", "c").agg(F.sum("support").alias("support"), F.sum("given").alias("given"), F.sum("tp").alias("tp"))
    part = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    by_class = by_class.withColumn("p", part(F.col("tp"), F.col("given"))).withColumn("r", part(F.col("tp"), F.col("support"))).withColumn("f", part(2 * F.col("tp"), F.col("given") + F.col("support")))
    return by_class.groupBy("model").agg(
        F.sum("support").alias("rows"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("p"), 6).alias("macro_precision"), F.round(F.avg("r"), 6).alias("macro_recall"), F.round(F.avg("f"), 6).alias("macro_f1"), F.round(F.sum(F.col("f") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"),
    )
