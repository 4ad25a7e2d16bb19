"""Dense document embeddings: TF-IDF weights, a truncated singular value decomposition, rows of unit length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import written
from . import text

#: Rows of a block that a task multiplies at a time.
BLOCK = 2048


@dataclass(frozen=True)
class Decomposition:
    """Right singular vectors (features x rank), singular values, and the number and squared length of all rows."""

    right: np.ndarray
    values: np.ndarray
    rows: int
    energy: float

    @property
    def explained(self) -> float:
        """The part of the squared length of all rows that the rank keeps."""
        return float((self.values**2).sum() / self.energy) if self.energy else 0.0


def sparse_rows(weights: DataFrame, id_col: str, feature: str, weight: str) -> DataFrame:
    """(id, at, value): a row for each document with the numbers of its features, rising, and their weights."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(feature).cast("int").alias("at"), F.col(weight).cast("double").alias("value"))))
    return weights.groupBy(F.col(id_col).alias("id")).agg(pairs.alias("p")).select("id", F.col("p.at").alias("at"), F.col("p.value").alias("value"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, feature numbers, weights, first place of each row) of blocks of rows."""
    for pdf in batches:
        for lo in range(0, len(pdf), BLOCK):
            part = pdf.iloc[lo : lo + BLOCK]
            size = part["at"].map(len).to_numpy()
            part, size = part[size > 0], size[size > 0]
            if len(part):
                yield part["id"], np.concatenate(part["at"].to_numpy()).astype(np.int64), np.concatenate(part["value"].to_numpy()), np.append(0, np.cumsum(size)[:-1])


def _times(at: np.ndarray, value: np.ndarray, first: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    return np.add.reduceat(matrix[at] * value[:, None], first, axis=0)


def decompose(rows: DataFrame, features: int, rank: int, extra: int = 10, rounds: int = 4, seed: int = 0) -> Decomposition:
    """The ``rank`` greatest singular values and right vectors of sparse rows (id, at, value).

    Subspace rounds from a random start with ``extra`` further directions: every round is one pass, in which tasks take
    their rows times the directions and back; the sums, features x (rank + extra) numbers, are all that the driver holds.
    Vectors have their largest component positive. Fewer rows or features than ``rank`` give fewer vectors. ``rows``
    should be a written table: it is read ``rounds`` + 1 times.
    """
    spark = rows.sparkSession
    size = min(rank + extra, features)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, size)))
    names = [f"c{j}" for j in range(size)]

    def gathered(directions: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(directions)  # features x size numbers

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, met = np.zeros((features, size)), np.zeros(features, bool)
            for _, at, value, first in _blocks(batches):
                there = _times(at, value, first, shared.value)
                row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
                order = np.argsort(at, kind="stable")
                start = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
                total[at[order][start]] += np.add.reduceat(there[row[order]] * value[order][:, None], start, axis=0)
                met[at] = True
            found = np.flatnonzero(met)
            for lo in range(0, len(found), BLOCK):
                part = found[lo : lo + BLOCK]
                yield pd.DataFrame(total[part], columns=names).assign(at=part)

        sums = rows.mapInPandas(run, ", ".join(f"{n} double" for n in names) + ", at int").groupBy("at").agg(*(F.sum(n).alias(n) for n in names))
        out = np.zeros((features, size))
        for r in sums.toLocalIterator():  # at most ``features`` rows
            out[r["at"]] = r[1:]
        shared.unpersist()
        return out

    for _ in range(rounds):
        q, _ = np.linalg.qr(gathered(q))
    back = gathered(q)
    squares, turn = np.linalg.eigh((q.T @ back + back.T @ q) / 2)
    best = np.argsort(-squares)[:rank]
    best = best[squares[best] > max(float(squares.max(initial=0.0)), 0.0) * 1e-12]
    right = q @ turn[:, best]
    right *= np.where(right[np.abs(right).argmax(axis=0), np.arange(right.shape[1])] < 0, -1.0, 1.0) if right.size else 1.0
    n, energy = rows.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("value", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0))).first()
    return Decomposition(right, np.sqrt(np.maximum(squares[best], 0.0)), n, energy)


def project(rows: DataFrame, found: Decomposition, unit: bool = True) -> DataFrame:
    """(id, embedding): sparse rows times the right vectors, of unit length if ``unit``; rows without weights are zero."""
    shared = rows.sparkSession.sparkContext.broadcast(found.right)
    width = found.right.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            zero = pdf[pdf["at"].map(len) == 0]
            if len(zero):
                yield pd.DataFrame({"id": zero["id"], "embedding": [np.zeros(width)] * len(zero)})
            for ids, at, value, first in _blocks(iter([pdf])):
                there = _times(at, value, first, shared.value)
                if unit:
                    length = np.linalg.norm(there, axis=1, keepdims=True)
                    there = np.divide(there, length, out=np.zeros_like(there), where=length > 0)
                yield pd.DataFrame({"id": ids.to_numpy(), "embedding": list(there)})

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, embedding array<double>")


@dataclass(frozen=True)
class TextEmbedding:
    """A fitted vocabulary (term, at, idf) with its decomposition."""

    terms: DataFrame
    found: Decomposition

    def weights(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return sparse_rows(text.weigh(docs, id_col, text_col, self.terms), id_col, "at", "weight")

    def embed(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, embedding) of the documents with at least one term of the vocabulary."""
        return project(self.weights(docs, id_col, text_col), self.found)

    def info(self) -> dict:
        """What a stored set of embeddings says about itself."""
        values = [float(v) for v in self.found.values]
        return {"features": int(self.found.right.shape[0]), "dimension": len(values), "rows": self.found.rows, "explained": self.found.explained, "singular_values": values}


def fit_text(docs: DataFrame, id_col: str, text_col: str, least: int, most: float, features: int, rank: int, rounds: int = 4, seed: int = 0) -> TextEmbedding:
    """Fits a vocabulary of at most ``features`` terms and ``rank`` dimensions to all documents."""
    terms, n = text.vocabulary(docs, text_col, least, most, features)
    listed = sorted((r.term, r.df) for r in terms.collect())  # at most ``features`` rows
    rows = [(t, k, float(np.log((n + 1.0) / (df + 1.0)) + 1.0)) for k, (t, df) in enumerate(listed)]
    known = docs.sparkSession.createDataFrame(rows, "term string, at int, idf double")
    blank = TextEmbedding(known, Decomposition(np.zeros((0, 0)), np.zeros(0), 0, 0.0))
    sparse = written(blank.weights(docs, id_col, text_col), "sparse-rows")
    return TextEmbedding(known, decompose(sparse, max(len(rows), 1), rank, rounds=rounds, seed=seed))


def save(spark: SparkSession, embeddings: DataFrame, info: dict, path: str) -> None:
    """Writes embeddings as Parquet with a manifest of one JSON line beside them; the manifest comes last."""
    embeddings.write.parquet(f"{path}/vectors")
    spark.createDataFrame([info]).coalesce(1).write.json(f"{path}/manifest")
