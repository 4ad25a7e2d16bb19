"""Nested payloads: lists of JSON texts between semicolons, and works whose parts become aligned lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bound, doi_plain, nonblank

#: Whole strings (to the end of the text where one is not closed) and anything but brackets and semicolons.
_PLAIN = r"(?:\"(?:[^\"\\]++|\\.)*+\"?|[^\"\[{\]};]++)"
#: A bracket with its contents, where these are closed and hold no more than one bracket within another; a lone bracket; a
#: semicolon; or what is between these.
_PIECE = rf"(?s)[\[{{](?:{_PLAIN}|;|[\[{{](?:{_PLAIN}|;)*+[\]}}])*+[\]}}]|[\[{{\]}};]|{_PLAIN}++"

#: The nested parts of a work that ``flat_works`` reads; other members are ignored.
WORK = """
id string, doi string, title string, display_name string, publication_year int, publication_date string, type string, cited_by_count long, language string, is_retracted boolean,
authorships array<struct<author:struct<display_name:string,orcid:string>,author_position:string,is_corresponding:boolean,raw_affiliation_strings:array<string>,countries:array<string>,institutions:array<struct<id:string,display_name:string,country_code:string>>>>,
primary_location struct<landing_page_url:string,pdf_url:string,license:string,source:struct<display_name:string,type:string,issn_l:string,host_organization_name:string>>,
locations array<struct<landing_page_url:string,pdf_url:string,license:string,version:string,source:struct<display_name:string,type:string>>>,
primary_topic struct<display_name:string,field:struct<display_name:string>,subfield:struct<display_name:string>,domain:struct<display_name:string>>,
topics array<struct<display_name:string,field:struct<display_name:string>,subfield:struct<display_name:string>,domain:struct<display_name:string>>>,
concepts array<struct<display_name:string>>, grants array<struct<funder_display_name:string,award_id:string>>, open_access struct<is_oa:boolean,oa_status:string>,
biblio struct<volume:string,issue:string,first_page:string,last_page:string>, referenced_works array<string>, referenced_works_count long
""".replace("\n", " ")


def inverted_index(words: Column, unlisted: Sequence[str] = ()) -> Column:
    """The index of a text's words: (word, places from 0) for each word, in the words' order; some may have places only."""

    def grouped(found: Column) -> Column:
        begins = F.array_compact(F.transform(found, lambda x, k: F.when((k == 0) | (x["word"] != F.get(found, k - 1)["word"]), k)))
        entry = lambda at, to: F.struct(F.get(found, at)["word"].alias("word"), F.transform(F.slice(found, at + 1, to - at), lambda x: x["place"]).alias("places"))
        return bound(begins, lambda b: F.transform(b, lambda at, k: entry(at, F.coalesce(F.get(b, k + 1), F.size(found)))))

    placed = F.transform(words, lambda w, k: F.struct(w.alias("word"), k.alias("place")))
    listed = F.filter(placed, lambda x: ~x["word"].isin(*unlisted)) if unlisted else placed
    return bound(F.sort_array(listed), grouped)


def text_of_index(index: Column) -> Column:
    """The words of an index (word, places) at their places, with spaces between; null for null."""
    placed = F.flatten(F.transform(index, lambda e: F.transform(e["places"], lambda p: F.struct(p.alias("place"), e["word"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["word"]), " ")


def split_payload(text: Column) -> Column:
    """The items of a list of JSON texts: cut at semicolons outside of strings and brackets, trimmed, without empty ones.

    A backslash in a string takes the next character with it; a bracket that closes nothing is passed over. Null and
    blank texts have no items.
    """
    return bound(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0)), _items)


def _items(pieces: Column) -> Column:
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("cuts"))

    def step(state: Column, piece: Column) -> Column:
        depth = F.when(piece.isin("[", "{"), state["depth"] + 1).when(piece.isin("]", "}"), F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        at = state["at"] + 1
        cut = (piece == ";") & (state["depth"] == 0)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(cut, F.array_append(state["cuts"], at)).otherwise(state["cuts"]).alias("cuts"))

    cuts = F.aggregate(pieces, start, step, lambda s: F.array_append(s["cuts"], s["at"] + 1))
    part = lambda a, b: F.regexp_replace(F.array_join(F.slice(pieces, a + 1, b - a - 1), ""), r"^\s+|\s+$", "")
    items = bound(cuts, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda a, k: part(a, F.get(c, k + 1))))
    return F.filter(items, lambda x: x != "")


def reference_rows(records: DataFrame, key: str, payload: str, *others: str) -> DataFrame:
    """(key, others, reference_index, reference_doi, _title, _author, _year, raw_reference_json): a row for each reference.

    Members come from the first of their names that is not blank; an item that is no JSON object has none.
    """
    items = records.select(key, *others, F.posexplode(split_payload(F.col(payload))).alias("at", "raw"))
    parsed = items.withColumn("m", F.from_json("raw", "map<string,string>"))
    member = lambda *names: F.coalesce(*(nonblank(F.try_element_at("m", F.lit(n))) for n in names))
    return parsed.select(
        key, *others, (F.col("at") + 1).alias("reference_index"), doi_plain(member("DOI", "doi")).alias("reference_doi"),
        member("article-title", "volume-title", "title", "unstructured").alias("reference_title"), member("author").alias("reference_author"), member("year").alias("reference_year"), F.col("raw").alias("raw_reference_json"),
    )


def _joined(items: Column) -> Column:
    """Distinct texts that are not blank, in order, joined by ``; ``; an empty text for none."""
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(kept), "; ")


def flat_works(rows: DataFrame, json_col: str, home: str = "LK") -> DataFrame:
    """A row of plain columns for each work given as JSON; texts that are no object give nulls and empty lists.

    Lists keep the order of the work and drop repeats. ``author_institutions`` and ``author_countries`` are aligned with
    ``author_list``: an item for each author, which may be empty. ``home`` is the country whose authors and institutions
    come out apart. Without a primary topic the first topic stands for it.
    """
    w = F.from_json(F.col(json_col), WORK)
    kept = [c for c in rows.columns if c != json_col]
    base = rows.select(*kept, w.alias("w"))
    a = F.coalesce("w.authorships", F.array().cast(base.select("w.authorships").schema[0].dataType))
    base = base.withColumn("a", F.filter(a, lambda x: x.isNotNull())).withColumn("t", F.coalesce("w.primary_topic", F.get("w.topics", F.lit(0))))
    institutions = lambda x: F.coalesce(x["institutions"], F.array().cast("array<struct<id:string,display_name:string,country_code:string>>"))
    countries = lambda x: F.array_distinct(F.array_compact(F.concat(F.transform(institutions(x), lambda i: F.upper(i["country_code"])), F.transform(F.coalesce(x["countries"], F.array().cast("array<string>")), lambda c: F.upper(c)))))
    name = lambda x: F.coalesce(x["author"]["display_name"], F.lit(""))
    at_home = lambda x: F.array_contains(countries(x), home)
    every = lambda of: F.flatten(F.transform("a", of))
    names_of = lambda x: F.transform(institutions(x), lambda i: i["display_name"])
    home_names = lambda x: F.transform(F.filter(institutions(x), lambda i: F.upper(i["country_code"]) == home), lambda i: i["display_name"])
    corresponding = F.filter("a", lambda x: F.coalesce(x["is_corresponding"], F.lit(False)))
    first, last = F.get("a", F.lit(0)), F.try_element_at("a", F.lit(-1))
    place = lambda *path: F.transform("w.locations", lambda x: x[path[0]] if len(path) == 1 else x[path[0]][path[1]])
    return base.select(
        *kept, F.regexp_replace(F.col("w.id"), "^https?://[^/]+/", "").alias("work_id"), doi_plain(F.col("w.doi")).alias("doi"), F.coalesce("w.title", "w.display_name").alias("title"), F.col("w.publication_year").alias("publication_year"), F.col("w.publication_date").alias("publication_date"),
        F.col("w.type").alias("type"), F.col("w.cited_by_count").alias("cited_by_count"), F.size("a").alias("author_count"), _joined(F.transform("a", name)).alias("authors"), _joined(F.transform(F.filter("a", at_home), name)).alias("home_authors"),
        _joined(every(names_of)).alias("institutions"), _joined(every(home_names)).alias("home_institutions"), _joined(every(countries)).alias("countries"), _joined(every(lambda x: F.coalesce(x["raw_affiliation_strings"], F.array().cast("array<string>")))).alias("raw_affiliation_strings"),
        F.array_join(F.transform("a", name), "; ").alias("author_list"), F.array_join(F.transform("a", lambda x: F.array_join(F.array_compact(names_of(x)), ", ")), "; ").alias("author_institutions"), F.array_join(F.transform("a", lambda x: F.array_join(countries(x), ", ")), "; ").alias("author_countries"),
        first["author"]["display_name"].alias("first_author_name"), _joined(F.when(first.isNotNull(), names_of(first))).alias("first_author_institution"), last["author"]["display_name"].alias("last_author_name"), _joined(F.transform(corresponding, name)).alias("corresponding_author_name"), _joined(F.flatten(F.transform(corresponding, countries))).alias("corresponding_author_countries"),
        F.exists("a", at_home).alias("has_home_author"), F.exists("a", lambda x: F.exists(countries(x), lambda c: c != home)).alias("has_foreign_author"), _joined(F.transform("w.grants", lambda g: g["funder_display_name"])).alias("funder"), _joined(F.transform("w.grants", lambda g: g["award_id"])).alias("grant_award"),
        F.col("w.primary_location.source.display_name").alias("source_name"), F.col("w.primary_location.source.host_organization_name").alias("publisher"), F.coalesce("w.is_retracted", F.lit(False)).alias("is_retracted"), F.col("w.open_access.is_oa").alias("is_oa"), F.col("w.open_access.oa_status").alias("oa_status"), F.col("w.primary_location.license").alias("license"),
        F.coalesce(F.size("w.locations"), F.lit(0)).alias("locations_count"), _joined(place("landing_page_url")).alias("location_urls"), _joined(place("source", "display_name")).alias("location_sources"), _joined(place("license")).alias("location_licenses"), _joined(F.transform("w.topics", lambda x: x["display_name"])).alias("topics"), _joined(F.transform("w.concepts", lambda x: x["display_name"])).alias("concepts"),
        F.col("t.display_name").alias("primary_topic"), F.col("t.field.display_name").alias("primary_field"), F.col("t.subfield.display_name").alias("primary_subfield"), F.col("t.domain.display_name").alias("primary_domain"), F.coalesce("w.referenced_works_count", F.size("w.referenced_works"), F.lit(0)).cast("long").alias("referenced_works_count"), F.col("w.language").alias("language"), F.col("w.biblio.volume").alias("volume"), F.col("w.biblio.first_page").alias("first_page"),
    )
