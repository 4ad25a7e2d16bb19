import json

from pyspark.sql import functions as F

from scholarmill.functions import mapping


def test_repository_formats(spark):
    dspace = {"dc.title": [], "dc.description": ["D"], "dc.creator": ["C"], "dc.contributor": ["X"], "dc.contributor.advisor": ["Y"], "dc.date.issued": ["May 2019"], "dc.identifier.uri": ["http://hdl.net/1)."], "dc.identifier.doi": ["https://doi.org/10.1234/Ab.c,"], "dc.language": ["en"]}
    html = {"citation_title": ["T"], "DC.creator": ["A", None, "B"], "citation_date": ["2020"], "DCTERMS.issued": [], "citation_doi": ["10.55555/x"]}
    rows = spark.createDataFrame([(1, json.dumps(dspace)), (2, "no json"), (3, None)], "id long, m string")
    got = {r.source_record_id: r for r in mapping.repository_records(rows, "dspace", "id", "m").collect()}
    r = got[1]
    assert (r.title, r.abstract, r.authors, r.contributors, r.publication_date, r.publication_year, r.language, r.doi, r.url) == (None, "D", ["C"], ["X", "Y"], "May 2019", 2019, "en", "10.1234/Ab.c", "http://hdl.net/1")
    for k in (2, 3):
        assert (got[k].authors, got[k].title, got[k].publication_year, got[k].doi, got[k].deleted) == ([], None, None, None, False)
    h = mapping.repository_records(spark.createDataFrame([(1, json.dumps(html))], "id long, m string"), "html_meta", "id", "m").first()
    assert (h.title, h.authors, h.publication_date, h.doi) == ("T", ["A", "B"], "2020", "10.55555/x")
    oai = spark.createDataFrame([(1, json.dumps({"date": ["2001-01-01T00:00:00Z", "1999", "2002-02-02T10:00:00Z"], "title": ["t"]}), False), (2, json.dumps({"title": ["gone"]}), True)], "id long, m string, d boolean")
    got = {r.source_record_id: r for r in mapping.repository_records(oai, "oai_dc", "id", "m", "d").collect()}
    assert (got[1].publication_date, got[1].publication_year) == ("1999", 1999) and got[2].title is None and got[2].deleted


def test_fields_by_precedence(spark):
    rows = spark.createDataFrame([(1, " ", "B", "x;y", "bad", "2020-13-01", "1999", "3.0"), (2, "A", None, None, "2020-05", None, "3000", None), (3, None, "nan", "one", None, "2021-02-03", None, "x"), (4, None, None, " ", None, None, "1850.0", None)], "id int, j string, k string, a string, d1 string, d2 string, y string, n string")
    got = {r.id: r for r in mapping.extracted(rows, {"journal": ["j", "k"], "authors": ["a"]}, ["d1", "d2"], "y", count="n").collect()}
    see = lambda r: (r.journal_clean, r.journal_source, r.author_list, r.author_count_clean, str(r.publication_date_clean), r.publication_date_source)
    assert see(got[1]) == ("B", "k", ["x", "y"], 3, "1999-01-01", "publication_year_fallback")
    assert see(got[2]) == ("A", "j", [], None, "2020-05-01", "d1")
    assert see(got[3]) == (None, None, ["one"], 1, "2021-02-03", "d2")
    assert see(got[4]) == (None, None, [], None, "1850-01-01", "publication_year_fallback")


def test_nested_identifiers(spark):
    rows = spark.createDataFrame([(1, '{"id":"a","x":{"id":"b"}}; plain ;{"k":[{"id":"c"},{"z":"d"}]}; plain'), (2, None), (3, "[]"), (4, "{broken")], "id int, t string")
    got = {r.id: r.funder_identifier for r in mapping.funder_identifiers(rows, "id", "t").collect()}
    assert got == {1: "a; plain; c; d", 2: None, 3: None, 4: "{broken"}


def test_author_lists(spark):
    texts = ["a; b|c", "a|b", "a\nb", "a, b, c, d", "a, b", " ", None]
    got = [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", mapping.author_list(F.col("t")).alias("x")).orderBy("k").collect()]
    assert got == [["a", "b|c"], ["a", "b"], ["a", "b"], ["a", "b", "c", "d"], ["a, b"], [], []]
