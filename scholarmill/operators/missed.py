"""Groups of records that merging may have missed, by four ways in turn; a set of records is reported once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ways with their confidence, the first to find a set of records reports it.
WAYS = (("duplicate_doi_after_dedup", "high"), ("title_year_first_author", "medium"), ("title_year", "low"), ("title_first_author_near_year", "low"))


def _same_set() -> Column:
    """Identity of a group's set of ids, without gathering them: count, ends and two sums of different hashes."""
    total = lambda seed: F.sum(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit((1 << 61) - 1)).cast("decimal(38,0)"))
    return F.struct(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), total(1).alias("s"), total(2).alias("t"))


def missed_duplicates(records: DataFrame, year_span: int = 1) -> DataFrame:
    """(method, confidence, key, n, first_id, doi_state, dois, years, year_span, sources) of ``records``.

    ``records(id, doi, title, year, author, source)`` are normalised: a DOI, title key, year (int) or first author that
    is not known is null; ids are distinct. Groups of two or more with one DOI; one title, year and first author; one
    title and year where no author is known; one title and author in two or more years at most ``year_span`` apart.
    """
    known = lambda c: F.col(c).isNotNull()
    all_doi = F.collect_set("doi")
    state = F.when(F.count("doi") == 0, "all_missing").when(F.count("doi") < F.count("*"), "some_missing").when(F.min("doi") == F.max("doi"), "same_doi").otherwise("different_doi")
    facts = (
        _same_set().alias("members"), F.count("*").alias("n"), F.min("id").alias("first_id"), state.alias("doi_state"), F.array_join(F.array_sort(all_doi), "; ").alias("dois"),
        F.array_join(F.transform(F.array_sort(F.collect_set("year")), lambda y: y.cast("string")), "; ").alias("years"), F.coalesce(F.max("year") - F.min("year"), F.lit(0)).alias("year_span"), F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"),
    )

    def groups(place: int, rows: DataFrame, *keys: str) -> DataFrame:
        method, confidence = WAYS[place]
        found = rows.groupBy(*keys).agg(*facts).where("n > 1")
        return found.select(F.lit(place).alias("place"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"), "members", "n", "first_id", "doi_state", "dois", "years", "year_span", "sources")

    full = records.where(known("title") & known("year") & known("author"))
    ways = groups(0, records.where(known("doi")), "doi")
    ways = ways.unionAll(groups(1, full, "title", "year", "author"))
    ways = ways.unionAll(groups(2, records.where(known("title") & known("year") & ~known("author")), "title", "year"))
    ways = ways.unionAll(groups(3, full, "title", "author").where(F.col("year_span").between(1, year_span)))
    columns = [c for c in ways.columns if c != "members"]
    first = ways.groupBy("members").agg(F.min(F.struct("place", "key", *(c for c in columns if c not in ("place", "key")))).alias("x"))
    return first.select(*(F.col(f"x.{c}").alias(c) for c in columns if c != "place"))
