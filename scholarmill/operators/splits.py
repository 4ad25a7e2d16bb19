"""Splits that keep everything that may be one publication together, stratified by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import doi_plain, is_doi, nonblank, title_key, year_in
from ..sources.work import written
from . import graph
from .ordered import running_by_group

#: Fixed value: titles of fewer characters name no publication.
SHORTEST_TITLE = 20


def identity_tokens(doi: Column | None = None, identifiers: dict[str, Column] | None = None, urls: dict[str, Column] | None = None, title: Column | None = None, year: Column | None = None) -> Column:
    """What a record may be known by, as texts that name their kind: a valid DOI, identifiers, addresses, a long title.

    A title counts alone and, where a year is known, with it. Blank values give nothing.
    """
    tokens: list[Column] = []
    if doi is not None:
        tokens.append(F.when(is_doi(doi), F.concat(F.lit("doi:"), doi_plain(doi))))
    for kinds, tail in ((identifiers or {}, ""), (urls or {}, "/+$")):
        for name, value in kinds.items():
            text = F.lower(nonblank(value))
            text = F.regexp_replace(F.regexp_replace(text, "^https?://(www\\.)?", ""), tail, "") if tail else text
            tokens.append(F.when(text != "", F.concat(F.lit(f"{name}:"), text)))
    if title is not None:
        key = title_key(title)
        long = F.length(key) >= SHORTEST_TITLE
        tokens.append(F.when(long, F.concat(F.lit("title:"), key)))
        if year is not None:
            tokens.append(F.when(long & year_in(year).isNotNull(), F.concat(F.lit("title_year:"), key, F.lit("|"), year_in(year).cast("string"))))
    return F.array_distinct(F.array_compact(F.array(*tokens))) if tokens else F.array().cast("array<string>")


def publication_groups(rows: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(id, group_id): records that are linked by tokens, over any number of others, are one group, named by its least id.

    Tokens are dealt out by their digests; a token of very many records is one node of the graph, with an edge to each.
    """
    known = rows.where(F.col(id_col).isNotNull())
    ids = known.select(F.col(id_col).alias("id")).distinct()
    owner = known.select(F.col(id_col).alias("id"), F.explode(tokens).alias("token"))
    first = owner.groupBy("token").agg(F.min("id").alias("target"))
    edges = owner.join(first, "token").where("id <> target").select(F.col("target").alias("source"), F.col("id").alias("target"), F.lit(1).alias("weight"))
    found = graph.components(edges).select(F.col("node").alias("id"), F.col("component").alias("group_id"))
    return ids.join(found, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def stratified_split(rows: DataFrame, id_col: str, label: str, tokens: str, parts: tuple[float, float, float] = (0.8, 0.1, 0.1), least: int = 1, seed: int = 0) -> DataFrame:
    """``rows`` with ``group_id`` and ``split`` (train, validation, test): whole groups, the same shares in every stratum.

    A group's stratum is its most frequent label, of equal ones the first. A stratum's groups come in the order of their
    seeded digests; the first part of them goes to training, the next to validation, the rest to testing, so that each
    part has its share to within one group. Rows with a blank label, labels of fewer than ``least`` rows and null ids
    are left out. The parts must be positive and sum up to 1, and two labels must remain.
    """
    if min(parts) <= 0 or abs(sum(parts) - 1) > 1e-9:
        raise ValueError("the parts must be positive and sum up to 1")
    usable = rows.withColumn(label, F.trim(F.col(label).cast("string"))).where((F.col(label) != "") & F.col(id_col).isNotNull())
    enough = usable.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    usable = written(usable.join(enough, label), "split-rows")
    if usable.select(label).distinct().limit(2).count() < 2:
        raise ValueError("a stratified split needs two labels")
    groups = written(publication_groups(usable, id_col, tokens).withColumnRenamed("id", id_col), "split-groups")
    counts = usable.join(groups, id_col).groupBy("group_id", label).agg(F.count("*").alias("n"))
    strata = counts.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label")))["label"].alias("stratum"))
    strata = strata.withColumn("one", F.lit(1)).withColumn("digest", F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id").cast("string"))))
    strata = written(strata, "split-strata")
    total = strata.groupBy("stratum").agg(F.count("*").alias("total"))
    placed = running_by_group(strata, "stratum", "digest", ["group_id"], "one", "before").join(total, "stratum")
    cut = lambda share: F.round(F.col("total") * share + 1e-9)
    split = F.when(F.col("before") < cut(parts[0]), "train").when(F.col("before") < cut(parts[0] + parts[1]), "validation").otherwise("test")
    return usable.join(groups, id_col).join(placed.select("group_id", split.alias("split")), "group_id")
