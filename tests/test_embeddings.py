import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarmill.operators import embeddings, text


def frame(spark, matrix):
    rows = [(k, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for k, r in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, at array<int>, value array<double>").repartition(3)


@pytest.mark.parametrize("shape, rank", [((120, 60), 8), ((40, 200), 5), ((6, 30), 10)])
def test_decomposition_agrees_with_that_of_the_dense_matrix(spark, shape, rank):
    rng = np.random.default_rng(shape[0])
    low = rng.standard_normal((shape[0], 4)) @ rng.standard_normal((4, shape[1]))
    matrix = np.where(rng.random(shape) < 0.3, low + rng.standard_normal(shape), 0.0)
    matrix[1] = 0
    found = embeddings.decompose(frame(spark, matrix), shape[1], rank)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    k = len(found.values)
    assert k == min(rank, np.linalg.matrix_rank(matrix))
    best = np.linalg.norm(matrix - (u[:, :k] * s[:k]) @ vt[:k])
    mine = np.linalg.norm(matrix - matrix @ found.right @ found.right.T)
    assert mine <= 1.01 * best + 1e-6
    assert np.allclose(found.right.T @ found.right, np.eye(k), atol=1e-8)
    assert found.rows == shape[0] and found.explained == pytest.approx((found.values**2).sum() / (matrix**2).sum())
    got = {r.id: np.array(r.embedding) for r in embeddings.project(frame(spark, matrix), found).collect()}
    assert len(got) == shape[0] and not got[1].any()
    there = matrix @ found.right
    for k, v in got.items():
        if k != 1:
            assert np.allclose(v, there[k] / np.linalg.norm(there[k]), atol=1e-9)


def test_text_embeddings_put_texts_of_one_theme_together(spark, tmp_path):
    rng = np.random.default_rng(0)
    themes = [[f"a{k}" * 2 for k in range(12)], [f"b{k}" * 2 for k in range(12)], [f"c{k}" * 2 for k in range(12)]]
    rows = [(k, " ".join(rng.choice(themes[k % 3], 30)), 0) for k in range(90)] + [(500, None, 0), (501, "nothing known", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    fitted = embeddings.fit_text(docs, "doc_id", "text", least=2, most=0.9, features=100, rank=3)
    got = {r.id: np.array(r.embedding) for r in fitted.embed(docs, "doc_id", "text").collect()}
    assert set(got) == set(range(90))
    for a in range(30):
        assert got[a] @ got[a + 3] > 0.9 > 0.5 > abs(got[a] @ got[a + 1])
    embeddings.save(spark, fitted.embed(docs, "doc_id", "text"), fitted.info(), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e/vectors")).count() == 90
    assert spark.read.json(str(tmp_path / "e/manifest")).first().dimension == 3


def test_weights_of_given_terms(spark):
    docs = spark.createDataFrame([(1, "x x y"), (2, "y z"), (3, None)], "id long, text string")
    terms = spark.createDataFrame([("x", 0, 2.0), ("y", 1, 1.0)], "term string, at int, idf double")
    got = {(r.id, r.at): round(r.weight, 6) for r in text.weigh(docs, "id", "text", terms).select("id", "at", F.col("weight")).collect()}
    assert got == {(1, 0): round(4 / 17**0.5, 6), (1, 1): round(1 / 17**0.5, 6), (2, 1): 1.0}
