"""Calibrators of scores, fitted to labels of 0 and 1: isotonic and sigmoid."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import written
from .ordered import running


def by_score(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(score, n, positives), a row for each distinct score, written. Null scores and labels are left out."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return written(known.groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives")), "scores")


def _both_labels(scores: DataFrame) -> tuple[int, int]:
    n, positives = scores.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("positives"), F.lit(0))).first()
    if not 0 < positives < n:
        raise ValueError("a calibrator needs both labels")
    return n, positives


def _pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks (lo, hi, n, positives) in ascending order of scores, pooled until their shares rise."""
    blocks: list[tuple[float, float, int, int]] = []
    for pdf in batches:
        for lo, hi, n, positives in pdf[["lo", "hi", "n", "positives"]].itertuples(index=False):
            # shares as products, so that equal ones are equal
            while blocks and blocks[-1][3] * n >= positives * blocks[-1][2]:
                lo, _, m, p = blocks.pop()
                n, positives = n + m, positives + p
            blocks.append((lo, hi, int(n), int(positives)))
    if blocks:
        yield pd.DataFrame(blocks, columns=["lo", "hi", "n", "positives"])


def isotonic(scores: DataFrame) -> DataFrame:
    """(lo, hi, n, positives, value): the blocks of the rising step function nearest to the labels of ``by_score`` rows.

    Scores are cut into ranges and pooled there; what is left of all ranges is pooled once more in order. Shares that rise
    are distinct fractions, so that n labels leave some n to the power of 2/3 blocks at most. Equal shares are one block.
    """
    _both_labels(scores)
    blocks = scores.select(F.col("score").alias("lo"), F.col("score").alias("hi"), "n", "positives")
    kind = "lo double, hi double, n long, positives long"
    parts = written(blocks.repartitionByRange("lo").sortWithinPartitions("lo").mapInPandas(_pool, kind), "blocks")
    found = parts.repartition(1).sortWithinPartitions("lo").mapInPandas(_pool, kind)  # blocks, not scores
    return written(found.withColumn("value", F.col("positives") / F.col("n")), "isotonic")


@dataclass(frozen=True)
class Isotonic:
    """Places and values of an isotonic fit, to be interpolated between; scores beyond the ends take the ends' values."""

    places: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(blocks: DataFrame) -> Isotonic:
        rows = blocks.orderBy("lo").toPandas()  # blocks of ``isotonic``
        return Isotonic(np.repeat(rows[["lo", "hi"]].to_numpy(), 1, axis=0).ravel(), np.repeat(rows["value"].to_numpy(), 2))

    def column(self, score: Column) -> Column:
        places, values = self.places, self.values

        @F.pandas_udf("double")
        def value(s: pd.Series) -> pd.Series:
            x = s.to_numpy(dtype=float, na_value=np.nan)
            return pd.Series(np.where(np.isnan(x), np.nan, np.interp(x, places, values))).where(s.notna())

        return value(score.cast("double"))


@dataclass(frozen=True)
class Sigmoid:
    """1 / (1 + exp(-(slope x score + offset)))."""

    slope: float
    offset: float

    def column(self, score: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(score.cast("double") * self.slope + self.offset)))


def sigmoid(scores: DataFrame, penalty: float = 1.0, steps: int = 50, enough: float = 1e-10) -> Sigmoid:
    """The logistic fit to ``by_score`` rows, with ``penalty`` / 2 times the squared slope, by Newton steps.

    Every step is one aggregate over the distinct scores. A step that does not lower the loss is halved.
    """
    _both_labels(scores)
    x, n, y = F.col("score"), F.col("n"), F.col("positives")

    def sums(slope: float, offset: float) -> tuple[float, ...]:
        z = x * slope + offset
        p = 1.0 / (1.0 + F.exp(-z))
        loss = F.sum(n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - y * z)
        e, w = n * p - y, n * p * (1 - p)
        row = scores.agg(loss, F.sum(e * x), F.sum(e), F.sum(w * x * x), F.sum(w * x), F.sum(w)).first()
        return row[0] + penalty * slope * slope / 2, row[1] + penalty * slope, row[2], row[3] + penalty, row[4], row[5]

    slope, offset = 0.0, 0.0
    now = sums(slope, offset)
    for _ in range(steps):
        loss, ga, gb, haa, hab, hbb = now
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        if max(abs(da), abs(db)) < enough:
            break
        share = 1.0
        while True:
            now = sums(slope - share * da, offset - share * db)
            if now[0] <= loss + 1e-12 * abs(loss) or share < 1e-6:
                break
            share /= 2
        slope, offset = slope - share * da, offset - share * db
    return Sigmoid(slope, offset)


def metrics(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """One row: records, positives, negatives, Brier score, expected calibration error, area under the curve.

    Scores count within 0 and 1. The area is null with one label only; ties count half.
    """
    held = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn(score, F.greatest(F.least(F.col(score).cast("double"), F.lit(1.0)), F.lit(0.0)))
    scores = by_score(held, score, label)
    bin_of = F.greatest(F.ceil(F.col("score") * bins) - 1, F.lit(0))
    error = scores.groupBy(bin_of.alias("b")).agg(F.sum("n").alias("n"), F.sum(F.col("score") * F.col("n")).alias("s"), F.sum("positives").alias("y"))
    error = error.agg((F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("expected_calibration_error"))
    plain = scores.agg(F.sum("n").alias("records"), F.sum("positives").alias("positives"), (F.sum("n") - F.sum("positives")).alias("negatives"), (F.sum(F.col("positives") * F.pow(1 - F.col("score"), 2) + (F.col("n") - F.col("positives")) * F.pow("score", F.lit(2))) / F.sum("n")).alias("brier_score"))
    below = running(scores.withColumn("negatives", F.col("n") - F.col("positives")), ["score"], {"below": "negatives"})
    won = F.sum(F.col("positives") * (F.col("below") - F.col("negatives") / 2.0))
    area = below.agg((won / F.nullif(F.sum("positives") * F.sum("negatives").cast("double"), F.lit(0.0))).alias("roc_auc"))
    return plain.crossJoin(error).crossJoin(area)  # one row each
