"""Full-text search: a positional inverted index as a stored table, prefix terms, cover-density rank.

The index has a row for each term of a document, with the places of the term. It is written in ranges of terms and under
the terms' first letters, so that a search reads the parts of the table that hold its terms, and no texts.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payloads import inverted_index
from ..functions.stems import STOP_WORDS, with_stems
from ..sources.work import shared_folder, written

_WORDS = r"[^\p{L}\p{N}]+"
#: Fixed value: what a place of a term without a weight of its own counts for.
WEIGHT = 0.1


def _head(term: Column) -> Column:
    """The folder of a term: its first letter or digit, or ``other``; at most 37 folders."""
    first = F.substring(term, 1, 1)
    return F.when(first.rlike("^[a-z0-9]$"), first).otherwise("other")


def build_index(docs: DataFrame, id_col: str, *columns: str, path: str | None = None) -> DataFrame:
    """The stored index (term, id, places) of the words of some columns, taken one after another, null as empty.

    Words are lower-cased runs of letters and digits; terms are their English stems. Stop words have no terms, but count
    as places. Equal ids are one document, whose places are those of all its rows. A row's places are put together in the
    row, and words get their stems as distinct words, once each, so that entries are shuffled for the ranges and, but for
    numbers and where stems are few, for the join with the stems. ``path`` names the folder of the index; it is a new one in the shared folder by default.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    words = F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), _WORDS), lambda w: w != "")
    entries = docs.select(F.col(id_col).alias("id"), F.explode(inverted_index(words, STOP_WORDS)).alias("e")).select("e.word", "id", "e.places")
    by_word = written(entries, "postings")
    number = F.col("word").rlike("^[0-9]+$")  # its own stem
    stems = written(with_stems(by_word.where(~number).select("word").distinct()).select("word", F.col("stem").alias("term")), "stems")
    named = by_word.where(~number).join(stems, "word").select("term", "id", "places").unionAll(by_word.where(number).select("word", "id", "places"))
    terms = named.select(_head(F.col("term")).alias("head"), "term", "id", "places")
    # a range has all rows of its terms and ids, so that they are put together where they lie
    ranged = terms.repartitionByRange("head", "term", "id").groupBy("head", "term", "id").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    ranged.select("term", "id", "places", "head").sortWithinPartitions("head", "term", "id").write.partitionBy("head").parquet(path)
    return open_index(spark, path, dict(docs.dtypes)[id_col])


def open_index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"term string, id {id_type}, places array<int>, head string").parquet(path)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The stems of a query's words, each once, without stop words."""
    words = [w for w in dict.fromkeys(re.findall("[a-z0-9]+", query.casefold())) if w not in STOP_WORDS]
    if not words:
        return []
    found = {r.word: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in words], "word string")).collect()}  # a query's words
    return list(dict.fromkeys(found[w] for w in words))


def postings(index: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of the index whose term begins with one of ``terms``, with ``items``: which of them."""
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | ((F.col("head") == (t[0] if re.match("[a-z0-9]", t) else "other")) & F.startswith("term", F.lit(t)))
    items = F.array_compact(F.array(*(F.when(F.startswith("term", F.lit(t)), k) for k, t in enumerate(terms))))
    return index.where(wanted).select("term", "id", "places", items.alias("items"))


def ranked(index: DataFrame, terms: list[str]) -> DataFrame:
    """(id, covers, rank) of the documents in which every one of ``terms`` begins some term.

    A cover is a shortest run of places that holds all terms: no part of it does. It counts ``WEIGHT`` over one more than
    the number of its other places. No terms, no documents.
    """
    if not terms:
        return index.select("id", F.lit(0).cast("long").alias("covers"), F.lit(0.0).alias("rank")).limit(0)
    entries = postings(index, terms).groupBy("id").agg(F.collect_list(F.struct("places", "items")).alias("lists"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("met")).where(F.size("met") == len(terms))
    merged = F.array_sort(F.flatten(F.transform("lists", lambda x: F.transform(x["places"], lambda p: F.struct(p.alias("place"), x["items"].alias("items"))))))
    none = F.struct(F.lit(-1).alias("place"), F.lit(0).alias("at"))
    start = F.struct(F.array(*[none] * len(terms)).alias("last"), F.lit(0).alias("at"), F.lit(-1).alias("begin"), F.lit(0).cast("long").alias("covers"), F.lit(0.0).alias("rank"))

    def take(state: Column, entry: Column) -> Column:
        at = state["at"] + 1
        own = F.struct(entry["place"].alias("place"), at.alias("at"))
        last = F.transform(state["last"], lambda x, k: F.when(F.array_contains(entry["items"], k), own).otherwise(x))
        first = F.array_min(last)
        fresh = first["place"] > state["begin"]
        others = entry["place"] - first["place"] - (at - first["at"])
        return F.struct(
            last.alias("last"), at.alias("at"), F.greatest(state["begin"], first["place"]).alias("begin"),
            (state["covers"] + fresh.cast("long")).alias("covers"), (state["rank"] + F.when(fresh, WEIGHT / (1.0 + others)).otherwise(0.0)).alias("rank"),
        )

    return entries.select("id", F.aggregate(merged, start, take).alias("s")).select("id", "s.covers", "s.rank")


def search_page(index: DataFrame, records: DataFrame, id_col: str, query: str, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page of the records that match a query, with their ``rank`` and the ``total`` of matches.

    The most relevant come first, ties by ``order``, which should end in a key. Only a page is sorted out of the matches.
    """
    found = written(ranked(index, query_terms(index.sparkSession, query)), "matches")
    total = found.agg(F.count("*").alias("total"))
    rows = records.join(found.select(F.col("id").alias(id_col), "rank"), id_col).orderBy(F.desc(F.round("rank", 9)), *order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total))  # the total is one row
