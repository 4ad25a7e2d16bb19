import random

import pytest

from scholarmill.operators import classifiers


def test_four_models_on_one_split(spark):
    rng = random.Random(4)
    words = {y: [f"{y}{k}" for k in range(8)] for y in ("a/x", "a/y", "b/x", "b/y", "c/z")}
    common = {p: [f"{p}common{k}" for k in range(4)] for p in "abc"}
    rows = []
    for k in range(300):
        y = rng.choice(list(words))
        rows.append((k, " ".join(rng.choice(words[y] + common[y[0]]).replace("/", "q") for _ in range(20)), y, y[0]))
    rows += [(1000, None, "a/x", "a"), (1001, "nothing", None, "a")]
    docs = spark.createDataFrame(rows, "id long, text string, label string, parent string")
    train, test = docs.where("id % 4 <> 0 OR id >= 1000"), docs.where("id % 4 = 0 AND id < 1000")
    found = classifiers.predictions(train, test, "id", "text", "label", "parent", size=1 << 10, rounds=10)
    got = {r.model: r for r in classifiers.comparison(found, "label").collect()}
    assert set(got) == set(classifiers.MODELS)
    for r in got.values():
        assert r.rows == 75 and r.accuracy > 0.95 and r.macro_f1 > 0.9
    assert {r.predicted[0] for r in found.where("model = 'hierarchical_svm' AND label = 'c/z'").collect()} == {"c"}


def test_comparison_by_hand(spark):
    rows = [("m", "a", "a"), ("m", "a", "b"), ("m", "b", "b"), ("m", "c", "b"), ("n", "a", "a")]
    got = {r.model: r for r in classifiers.comparison(spark.createDataFrame(rows, "model string, label string, predicted string"), "label").collect()}
    m = got["m"]
    assert (m.rows, m.accuracy) == (4, 0.5) and m.macro_precision == pytest.approx((1 + 1 / 3 + 0) / 3, abs=1e-6)
    assert m.macro_recall == pytest.approx((0.5 + 1 + 0) / 3, abs=1e-6) and m.weighted_f1 == pytest.approx((2 * 2 / 3 + 0.5) / 4, abs=1e-6)
    assert got["n"].macro_f1 == 1
