import pytest
from pyspark.sql import functions as F

from scholarmill.functions import columns as C
from scholarmill.functions.names import clean_title, compatible, parse_name
from scholarmill.operators import filters, graph, merge, models


def apply(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("v"))).collect()]


def test_dois(spark):
    assert apply(spark, C.doi_plain, ["https://doi.org/10.1/AB.", "doi: 10.2/x)", " ", None]) == ["10.1/ab", "10.2/x", None, None]
    assert apply(spark, C.doi_strict, ["see 10.1234/Ab,", "none", None]) == ["10.1234/ab", None, None]
    assert apply(spark, C.is_doi, ["10.1234/x", "10.1/x", None]) == [True, False, False]


def test_dates_years_languages(spark):
    assert apply(spark, C.partial_date, ["2020", "2020-5", "2020-13-01", "2020-02-31", "2020-02-03", "25/12/2020", "1/2/2020", "", None]) == ["2020", "2020-05", "2020", "2020-02", "2020-02-03", "2020-12-25", "2020-01-02", None, None]
    assert apply(spark, C.year_in, ["c. 1987", "12", None]) == [1987, None, None]
    assert apply(spark, C.language_code, ["EN-us", " ", None, "English"]) == ["en", "unknown", "unknown", "en"]


def test_lists_and_keys(spark):
    assert apply(spark, lambda c: C.distinct_caseless(C.split_list(c)), ["B; a;b ;; A", "", None]) == [["B", "a"], [], []]
    assert apply(spark, C.slug, [" Ünï  Köln! ", "--"]) == ["ünï-köln", ""]
    assert apply(spark, C.orcid, ["https://orcid.org/0000-0002-1825-0097", "0000-0002-1825-0098", None]) == ["0000-0002-1825-0097", None, None]
    assert apply(spark, C.looks_like_institution, ["Uni of X", "Dept. University, Y", None]) == [False, True, False]


def test_names_and_titles():
    assert parse_name("Dr. Ana M. de Silva") == {"surname": "de silva", "given": ["ana", "m"]}
    assert parse_name("Silva, Ana M.") == {"surname": "silva", "given": ["ana", "m"]}
    assert parse_name("Silva AM") == {"surname": "silva", "given": ["a", "m"]}
    assert parse_name(None) == {"surname": "", "given": []}
    assert compatible(["ana"], ["a"]) and not compatible(["ana"], ["anna"])
    assert clean_title("A &amp;lt;b&amp;gt;x&amp;lt;/b&amp;gt; CO<sub>2</sub> , y") == "A x CO2, y"
    assert clean_title(None) is None


def test_filters(spark):
    rows = spark.createDataFrame([(1, "a", None, 2000, "X; Y"), (2, "b", True, 2005, "Z")], "publication_key int, type string, is_oa boolean, publication_year int, authors string")
    assert [r[0] for r in rows.where(filters.where({"is_oa": False})).collect()] == []
    assert [r[0] for r in rows.where(filters.where({"type": []})).collect()] == []
    assert [r[0] for r in rows.where(filters.where({"authors": ["y"], "year_max": 2004})).collect()] == [1]
    assert filters.from_query({"type": "a, b", "is_oa": "yes", "year_min": "1990"}) == {"type": ["a", "b"], "is_oa": True, "year_min": 2016, "year_max": 2026}
    with pytest.raises(ValueError):
        filters.from_query({"year_min": "2025", "year_max": "2020"})
    with pytest.raises(ValueError):
        filters.where({"nothing": 1})


def test_graph_figures(spark):
    # a path 1-2-3-4 and a triangle
    edges = spark.createDataFrame([("1", "2", 1.0), ("2", "3", 1.0), ("3", "4", 1.0), ("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)], "source string, target string, weight double")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {"1": "1", "2": "1", "3": "1", "4": "1", "a": "a", "b": "a", "c": "a"}
    path = edges.where("source < 'a'")
    got = {r.node: r for r in graph.path_centrality(path).collect()}
    assert got["2"].betweenness == pytest.approx(4 / 6) and got["1"].betweenness == 0
    assert got["1"].closeness == pytest.approx(3 / 6) and got["2"].closeness == pytest.approx(3 / 4)
    groups = graph.communities(edges)
    assert groups.select("community").distinct().count() >= 2
    assert graph.modularity(edges, groups).first().modularity > 0.3


def test_star_and_chain_components(spark):
    edges = spark.createDataFrame([("hub", f"leaf{k:03}", 1) for k in range(300)] + [(f"n{k:03}", f"n{k + 1:03}", 1) for k in range(120)], "source string, target string, weight int")
    got = graph.components(edges).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {("hub", 301), ("n000", 121)}


def test_merging(spark):
    rows = spark.createDataFrame([("k", 1, 2, " ", "a; B"), ("k", 2, 1, "n/a", "b; c"), ("k", 3, 3, "T", None)], "k string, i int, p int, title string, tags string")
    got = merge.merge_groups(rows, "k", [F.col("p"), F.col("i")], ["title"], ["tags"]).first()
    assert (got.title, got.tags, got.group_size) == ("T", "b; c; a", 3)
    assert merge.conflicts(rows.withColumn("title", F.col("i").cast("string")), "k", ["title", "tags"]).first().conflict_fields == "title,tags"


def test_p_value(spark):
    assert models._tail(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert models._tail(0.0, 5) == 1.0
    assert models._tail(1.0, 1) == pytest.approx(0.5, abs=1e-6)


def test_forecast_of_a_line(spark):
    series = spark.createDataFrame([("t", 2000 + k, float(k)) for k in range(8)], "topic string, period int, value double")
    got = {r.method: r.mae for r in models.forecasts(series).collect()}
    assert got["linear"] == pytest.approx(0, abs=1e-9) and got["naive"] == pytest.approx(1.5)
