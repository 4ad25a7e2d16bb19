import json

import pytest
from pyspark.sql import functions as F

from scholarmill.sources import paged, readers, sinks
from scholarmill.sources.tables import publications, table
from scholarmill.streaming import incremental

from .oracle import DATA


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a ""b""\nc"\nNA,\n')
    rows = [tuple(r) for r in readers.load(spark, f"{tmp_path}/a.csv").collect()]
    assert rows == [("1", 'a "b"\nc'), ("NA", "")]
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"t": "x"}, {"t": "y", "u": 1}]}))
    assert readers.load(spark, f"{tmp_path}/b.json").count() == 2
    (tmp_path / "c.jsonl").write_text('{"t": "x"}\n{"t": "z"}\n')
    assert {r.t for r in readers.load(spark, f"{tmp_path}/c.jsonl", required=("t",)).collect()} == {"x", "z"}
    (tmp_path / "d.xml").write_text("<all><r><t>x</t></r><r><t>y</t></r></all>")
    assert {r.t for r in readers.load(spark, f"{tmp_path}/d.xml", tag="r").collect()} == {"x", "y"}
    with pytest.raises(ValueError):
        readers.load(spark, f"{tmp_path}/c.jsonl", required=("nothing",))
    with pytest.raises(ValueError):
        readers.format_of("x.bin")
    assert readers.format_of("x.CSV.gz") == "csv"


def test_union_and_mapping(spark):
    a = spark.createDataFrame([("T", 2020)], "paper_name string, published_year int")
    b = spark.createDataFrame([("U", "x")], "title string, other string")
    both = readers.union_sources([("a", readers.map_columns(a, {"paper_name": "title", "published_year": "publication_year"})), ("b", readers.map_columns(b, {}))])
    got = {r._source: (r.title, r.publication_year, r.source_specific_metadata) for r in both.collect()}
    assert got == {"a": ("T", "2020", {}), "b": ("U", None, {"other": "x"})}


PAGES = {"u": {"d": [1, 2], "next": "u2"}, "u2": {"d": [3], "next": "u"}}


def test_paging():
    assert list(paged.walk("u", "next_link", PAGES.__getitem__, "d", cursor="next")) == [1, 2, 3]
    asked = []

    def load(url):
        asked.append(url)
        return {"d": [{"k": len(asked)}] if len(asked) < 3 else [], "c": f"t{len(asked)}"}

    assert [r["k"] for r in paged.walk("u?x=1", "page", load, "d", size=5)] == [1, 2]
    assert asked == ["u?x=1&page=1&size=5", "u?x=1&page=2&size=5", "u?x=1&page=3&size=5"]
    asked.clear()
    assert len(list(paged.walk("u", "cursor", load, "d", cursor="c"))) == 2 and asked[1] == "u?cursor=t1"


def test_paged_source(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"items": [{"id": "a", "n": 1}, {"id": "b"}]}))
    spark.dataSource.register(paged.PagedSource)
    rows = spark.read.format("paged").schema("id string, n string").option("url", f"file://{tmp_path}/p.json").option("records", "items").load()
    assert {(r.id, r.n) for r in rows.collect()} == {("a", "1"), ("b", None)}


def test_sinks(spark, tmp_path):
    pub = publications(spark, DATA, "publication_key", "authors", "countries").limit(20)
    made = sinks.export_bundle(pub, str(tmp_path))
    assert set(made) == {"publications", "publication_authors", "authors", "publication_countries", "countries", "summary"}
    assert readers.read_csv(spark, f"{tmp_path}/publications").count() == 20
    sinks.write_jsonl(pub, f"{tmp_path}/j")
    assert readers.read_jsonl(spark, f"{tmp_path}/j").count() == 20


def test_upsert_batches(spark, tmp_path):
    events = table(spark, DATA, "events").select("user_id", "event_id", "value")
    events.where("event_id < 500").write.parquet(f"{tmp_path}/in/a.parquet")
    for part in ("a", "b"):
        if part == "b":
            events.where("event_id >= 500").write.parquet(f"{tmp_path}/in/b.parquet")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1000).parquet(f"{tmp_path}/in/*")
        incremental.upsert_batches(spark, stream, f"{tmp_path}/out", "user_id", f"{tmp_path}/state")
    last = spark.read.parquet(f"{tmp_path}/out/version=1")
    assert last.count() == events.select("user_id").distinct().count()
    assert incremental.start_date(None, "2024-02-28", "x") == "2024-02-29"


def test_scans_are_pruned(spark):
    plan = publications(spark, DATA, "publication_key", "publication_year").where(F.col("publication_year") > 1999)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "o_totalprice" not in plan
