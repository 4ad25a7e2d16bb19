"""Records of different sources in one schema: repository formats, and fields by precedence of columns."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import nonblank, split_list

_FIELDS = "map<string,array<string>>"
#: Where each format keeps what the common record has; of several fields the first that is there counts.
FORMATS: dict[str, dict[str, tuple[str, ...]]] = {
    "oai_dc": {
        "title": ("title",), "abstract": ("description",), "keywords": ("subject",), "authors": ("creator",), "contributors": ("contributor",), "publication_type": ("type",), "publisher": ("publisher",), "language": ("language",), "rights": ("rights",), "identifiers": ("identifier",), "dates": ("date",),
    },
    "dspace": {
        "title": ("dc.title",), "abstract": ("dc.description.abstract", "dc.description"), "keywords": ("dc.subject",), "authors": ("dc.contributor.author", "dc.creator"), "contributors": ("dc.contributor", "dc.contributor.advisor"), "publication_type": ("dc.type",), "publisher": ("dc.publisher",),
        "language": ("dc.language.iso", "dc.language"), "rights": ("dc.rights",), "identifiers": ("dc.identifier.uri", "dc.identifier.citation", "dc.identifier.doi"), "dates": ("dc.date.issued",),
    },
    "html_meta": {
        "title": ("DC.title", "citation_title"), "abstract": ("DCTERMS.abstract", "DC.description"), "keywords": ("DC.subject", "citation_keywords"), "authors": ("DC.creator", "citation_author"), "contributors": ("DC.contributor",), "publication_type": ("DC.type",), "publisher": ("DC.publisher", "citation_publisher"),
        "language": ("DC.language",), "rights": ("DC.rights",), "identifiers": ("DC.identifier", "DCTERMS.identifier", "citation_doi"), "dates": ("DCTERMS.issued", "citation_date"),
    },
}
#: Columns whose fields are taken all together.
_TOGETHER = {("oai_dc", "identifiers"), ("dspace", "identifiers"), ("html_meta", "identifiers"), ("dspace", "contributors")}


def _first_match(items: Column, pattern: str) -> Column:
    """The first match of a pattern in a list of texts, without closing punctuation; null for none."""
    found = F.filter(F.transform(items, lambda x: F.regexp_extract(x, pattern, 0)), lambda x: x != "")
    return F.regexp_replace(F.get(found, F.lit(0)), r"[.,)]+$", "")


def repository_records(rows: DataFrame, kind: str, id_col: str, metadata: str, deleted: str | None = None) -> DataFrame:
    """Records of one format in the common schema, lists as arrays.

    ``metadata`` is JSON: an object of lists of texts. Of the dates without fields of their own (``oai_dc``) the last one
    without a time of day is the date of issue, or the last one. The year is the first in that date or in any other. A
    deleted record keeps its identity only. Texts that are no object give empty records.
    """
    fields = FORMATS[kind]
    m = F.coalesce(F.from_json(F.col(metadata), _FIELDS), F.create_map().cast(_FIELDS))
    none = F.array().cast("array<string>")
    base = rows.select(F.col(id_col).alias("source_record_id"), (F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)).alias("deleted"), m.alias("m"))

    def listed(name: str) -> Column:
        each = [F.coalesce(F.filter(F.try_element_at("m", F.lit(f)), lambda x: x.isNotNull()), none) for f in fields[name]]
        if (kind, name) in _TOGETHER:
            return F.concat(*each)
        out = each[-1]
        for e in reversed(each[:-1]):
            out = F.when(F.size(e) > 0, e).otherwise(out)
        return out

    lists = base.select("source_record_id", "deleted", *(F.when(~F.col("deleted"), listed(n)).otherwise(none).alias(n) for n in fields))
    first = lambda c: F.get(c, F.lit(0))
    coarse = F.filter("dates", lambda d: ~F.contains(d, F.lit("T")))
    issued = F.coalesce(F.try_element_at(coarse, F.lit(-1)), F.try_element_at("dates", F.lit(-1))) if kind == "oai_dc" else first("dates")
    dated = lists.withColumn("publication_date", issued)
    years = F.filter(F.transform(F.concat(F.array("publication_date"), F.col("dates")), lambda d: F.regexp_extract(F.coalesce(d, F.lit("")), r"(1[5-9]\d{2}|20\d{2})", 1)), lambda y: y != "")
    return dated.select(
        F.lit("institutional_repository").alias("source"), "source_record_id", "deleted", *(first(c).alias(c) for c in ("title", "abstract")), "keywords", "authors", "contributors", "publication_date", first(years).cast("int").alias("publication_year"),
        *(first(c).alias(c) for c in ("publication_type", "publisher", "language", "rights")), _first_match(F.col("identifiers"), r"(?i)10\.\d{4,9}/[^\s\"'<>]+").alias("doi"), _first_match(F.col("identifiers"), r"https?://\S+").alias("url"), F.col("identifiers").alias("raw_identifiers"),
    )


def first_present(columns: list[str]) -> tuple[Column, Column]:
    """The first value of several columns that is not blank, and the name of its column."""
    value = F.coalesce(*(nonblank(F.col(c)) for c in columns))
    return value, F.coalesce(*(F.when(nonblank(F.col(c)).isNotNull(), c) for c in columns))


def author_list(value: Column) -> Column:
    """Names between semicolons, bars or line feeds, whichever is there first in this order, or between three commas and more."""
    cut = lambda mark: F.filter(F.transform(F.split(value, mark), lambda x: F.trim(x)), lambda x: x != "")
    commas = F.length(value) - F.length(F.replace(value, F.lit(","), F.lit("")))
    marked = F.when(F.contains(value, F.lit(";")), cut(";")).when(F.contains(value, F.lit("|")), cut(r"\|")).when(F.contains(value, F.lit("\n")), cut("\n")).when(commas >= 3, cut(","))
    return F.when(F.trim(value) != "", F.coalesce(marked, F.array(F.trim(value)))).otherwise(F.array().cast("array<string>"))


def extracted(rows: DataFrame, names: Mapping[str, list[str]], dates: list[str], year: str, authors: str = "authors", count: str | None = None) -> DataFrame:
    """``rows`` with a clean value and its source column for every name, the author list, and the date of publication.

    The date is the first of ``dates`` that is one (a year or month counts from its first day); without any, the first day
    of a year from 1000 to 2100 in ``year``. The number of authors is that of ``count``, or of the list.
    """
    out = rows
    for name, columns in names.items():
        value, source = first_present(columns)
        out = out.withColumns({f"{name}_clean": value, f"{name}_source": source})
    raw = F.coalesce(*(F.when(F.trim(F.col(c)) != "", F.col(c)) for c in names[authors]))
    whole = lambda c: F.try_to_date(F.concat(F.regexp_extract(c, r"^\s*(\d{4}(?:-\d{2}(?:-\d{2})?)?)", 1), F.when(F.trim(c).rlike(r"^\d{4}$"), "-01-01").when(F.trim(c).rlike(r"^\d{4}-\d{2}$"), "-01").otherwise("")), "yyyy-MM-dd")
    found = [whole(F.col(c).cast("string")) for c in dates]
    number = F.floor(F.col(year).cast("string").try_cast("double")).cast("int")
    late = F.when(number.between(1000, 2100), F.make_date(number, F.lit(1), F.lit(1)))
    listed = F.coalesce(author_list(raw), F.array().cast("array<string>"))
    given = F.floor(F.col(count).cast("string").try_cast("double")).cast("int") if count else F.lit(None).cast("int")
    return out.withColumns({
        "author_list": listed, "author_count_clean": F.coalesce(given, F.nullif(F.size(listed), F.lit(0))), "publication_date_clean": F.coalesce(*found, late),
        "publication_date_source": F.coalesce(*(F.when(f.isNotNull(), c) for f, c in zip(found, dates, strict=True)), F.when(late.isNotNull(), "publication_year_fallback"), F.lit("unresolved")),
    })


def _identifiers(value) -> list[str]:
    if isinstance(value, dict):
        if value.get("id") not in (None, ""):
            return [str(value["id"])]
        return [x for v in value.values() for x in _identifiers(v)]
    if isinstance(value, list):
        return [x for v in value for x in _identifiers(v)]
    return [str(value)] if value not in (None, "") else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_identifiers(texts: pd.Series) -> pd.Series:
    """Identifiers in a JSON text: the ``id`` of an object, or all values within it; other texts are identifiers themselves."""

    def one(text):
        if text is None or not text.strip():
            return []
        try:
            return _identifiers(json.loads(text))
        except ValueError:
            return [text.strip()]

    return texts.map(one)


def funder_identifiers(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, funder_identifier): the distinct identifiers of a list between semicolons, in order, joined by ``; ``."""
    parts = rows.select(key, F.posexplode_outer(split_list(F.col(column))).alias("at", "part")).withColumn("ids", nested_identifiers("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])
    ids = F.array_distinct(F.filter(F.transform(F.flatten(ordered), lambda x: nonblank(x)), lambda x: x.isNotNull()))
    return parts.groupBy(key).agg(F.nullif(F.array_join(ids, "; "), F.lit("")).alias("funder_identifier"))
