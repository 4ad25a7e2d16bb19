"""Quality classifier: supervised subword embeddings.

A text is the mean of learned vectors of its words and of the byte n-grams within its words, all hashed into one
table; a word that only says the one before again counts as a vector of its own. A softmax layer gives the class. Training is stochastic gradient descent in numpy over a bounded, balanced
sample of labelled rows. For scoring, the table's vectors are multiplied with the output layer once, so that a text's
score is the mean of its features' logits; this model, of fixed size, is broadcast and texts never leave their task.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, Rolling, mix64, slices, small_batches, utf8, words_of

#: Labelled rows of each class that training may use at most.
SAMPLE_PER_CLASS = 3000
N_GRAMS = (3, 4, 5)
#: Few examples are seen more often, up to so many steps in all.
LEAST_STEPS = 4000


class Model(NamedTuple):
    """Logit differences (label 1 less label 0) for each cell of the feature table, and the bias."""

    logit: np.ndarray
    bias: float


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, cells: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Feature cells of each word (its own and its byte n-grams', between word marks) and the index of their word."""
    size = end - start + 2
    at = np.cumsum(size) - size
    padded = np.full(int(size.sum()), ord("<"), np.uint8)
    inner = np.ones(len(padded), bool)
    inner[at], inner[at + size - 1] = False, False
    length = end - start
    padded[inner] = buf[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
    padded[at + size - 1] = ord(">")
    sums, word = rolling.sums(BYTE_VALUE[padded]), np.repeat(np.arange(len(start)), size)
    cell, owner = [hashes], [np.arange(len(start))]
    for n in N_GRAMS:
        p = np.arange(max(0, len(padded) - n + 1))
        p = p[word[p] == word[p + n - 1]] if len(p) else p
        cell.append(mix64(rolling.of(sums, p, p + n) + np.uint64(n)))
        owner.append(word[p])
    return (np.concatenate(cell) % np.uint64(cells)).astype(np.int64), np.concatenate(owner)


def _distinct(buf, off, rolling: Rolling):
    """Distinct words of some texts; for each word its distinct word, its text, and if it says the word before again."""
    start, end, hashes, first = words_of(buf, off, rolling, lower=False)
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    again = np.zeros(len(which), bool)
    again[1:] = (which[1:] == which[:-1]) & (doc[1:] == doc[:-1])
    return start[at], end[at], hashes[at], which, doc, again


def _features(cells: int):
    def run(batches):
        rolling = Rolling()
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for k in range(len(off) - 1):
                part = buf[off[k] : off[k + 1]]
                s, e, h, which, _, again = _distinct(part, np.array([0, len(part)]), rolling)
                cell, owner = word_features(part, s, e, h, cells, rolling) if len(s) else (np.zeros(0, np.int64),) * 2
                said = np.bincount(which[~again], minlength=len(s))
                total = np.bincount(cell, weights=said[owner].astype(float), minlength=cells + 1)
                total[cells] = np.bincount(owner, minlength=len(s))[which[again]].sum()
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([used.astype("<i4").tobytes()]), pa.array([total[used].astype("<f4").tobytes()])], names=["label", "cells", "counts"])

    return run


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], cells: int, dim: int = 8, epochs: int = 6, rate: float = 1.0, seed: int = 1) -> Model:
    """Stochastic gradient descent on (label, cells, counts) examples; no examples give a score of one half."""
    epochs = max(epochs, -(-LEAST_STEPS // max(1, len(examples))))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (cells + 1, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, step = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            label, idx, counts = examples[k]
            if len(idx):
                weight = counts / counts.sum()
                hidden = weight @ table[idx]
            else:
                hidden = np.zeros(dim, np.float32)
            z = hidden @ out + bias
            grad = np.exp(z - z.max())
            grad /= grad.sum()
            grad[label] -= 1
            lr = rate * (1 - step / steps)
            if len(idx):
                table[idx] -= lr * np.outer(weight, out @ grad).astype(np.float32)
            out -= lr * np.outer(hidden, grad)
            bias -= 0.1 * lr * grad
            step += 1
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", cells: int = 1 << 17, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most ``per_class`` rows of each class (0 and 1), chosen by a hash of their ids.

    ``docs``: doc_id, text; ``labels``: doc_id and the label; other labels and nulls are left out.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionAll(some)
    # at most twice ``per_class`` ids of 12 bytes are broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    small_batches(docs.sparkSession)
    features = sample.repartition(F.col("doc_id")).select("label", "text").mapInArrow(_features(cells), "label int, cells binary, counts binary")
    # one task learns from the bounded sample; the driver gets the model alone
    row = features.repartition(1).mapInArrow(_learn(cells), "logit binary, bias double").first()
    return Model(np.frombuffer(row.logit, "<f8"), row.bias) if row else fit([], cells)


def _learn(cells: int):
    def run(batches):
        examples = []
        for b in batches:
            for label, cell, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                examples.append((label, np.frombuffer(cell, "<i4"), np.frombuffer(count, "<f4")))
        examples.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()))
        model = fit(examples, cells)
        yield pa.RecordBatch.from_arrays([pa.array([model.logit.astype("<f8").tobytes()]), pa.array([model.bias])], names=["logit", "bias"])

    return run


def probabilities(text: pa.Array, model: tuple, rolling: Rolling) -> np.ndarray:
    """The probability of label 1 for each text."""
    logit, bias = model
    cells = len(logit) - 1
    buf, off = utf8(text)
    z = np.full(len(off) - 1, bias)
    for lo, hi in slices(off):
        part, bounds = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        s, e, h, which, doc, again = _distinct(part, bounds, rolling)
        if not len(s):
            continue
        cell, owner = word_features(part, s, e, h, cells, rolling)
        total, number = np.bincount(owner, weights=logit[cell], minlength=len(s)), np.bincount(owner, minlength=len(s))
        sums, counts = np.bincount(doc, weights=np.where(again, number[which] * logit[cells], total[which]), minlength=hi - lo), np.bincount(doc, weights=number[which], minlength=hi - lo)
        z[lo:hi] += sums / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-z))


def _score(model):
    def run(batches):
        rolling = Rolling()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities(batch.column(1), model.value, rolling))], names=["doc_id", "score"])

    return run


def _keep(model, text_at: int, least: float):
    def run(batches):
        rolling = Rolling()
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column(text_at), model.value, rolling) >= least))

    return run


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (text in column ``text``) that score ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    return docs.mapInArrow(_keep(shared, docs.columns.index("text"), least), docs.schema)


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability of label 1 for every whole text.

    Null and empty texts have no features: their score is the bias alone. Rows with a null id are scored too, and
    repeated rows each. Other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_score(shared), "doc_id long, score double")


def held_out(doc_id):
    """Rows that learning must not see: crc32 of the id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
