import pytest

from scholarmill.registry import ORACLE_SQL, QUERIES

from .oracle import DATA, compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    compare(QUERIES[name](spark, DATA), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"topic_model"}))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_topic_model_factors_every_weight(spark, tmp_path, monkeypatch):
    from scholarmill.plans import learning

    docs = [(d, " ".join(f"term{t}" for t in range(100) if (t + d) % 10 < 4 or d < 2)) for d in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(learning.models, "topics", lambda weights, *names, **options: weights)
    given = {r.doc_id: r["count"] for r in QUERIES["topic_model"](spark, str(tmp_path)).groupBy("doc_id").count().collect()}
    counts = {t: sum(f"term{t}" in x.split() for _, x in docs) for t in range(100)}
    assert given == {d: sum(counts[int(w[4:])] in range(5, 11) for w in x.split()) for d, x in docs}
    assert max(given.values()) > 40


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
