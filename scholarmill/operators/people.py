"""Author names resolved to people under constraints: identifiers, shared evidence, unique names, reviewers' decisions.

Links of each level form components. A component in which nothing forbids a merge becomes one person at once, wherever
its names stand. Only components that hold a contradiction are settled link by link, in the order of the names' mentions.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import name_parts
from ..sources.work import written
from . import graph

#: Names of one surname that are compared with each other; larger surnames are reported instead (identifiers still count).
BLOCK_NAMES = 2000
#: Clusters of a contradictory component that are settled link by link; larger ones stay apart and are reported.
CONTESTED = 20_000
#: Ways to merge, the weakest first.
METHODS = ("single_variant", "unique_name", "shared_coauthor", "shared_affiliation", "orcid", "reviewed")


def compatible_names(a: Column, b: Column) -> Column:
    """Whether two lists of given names can be one person's: name by name equal, or an initial of the other."""
    fits = F.zip_with(a, b, lambda x, y: x.isNull() | y.isNull() | (x == y) | (((F.length(x) == 1) | (F.length(y) == 1)) & (F.substring(x, 1, 1) == F.substring(y, 1, 1))))
    return F.forall(fits, lambda x: x)


def _clash(spelled: Column) -> Column:
    """Whether two of a list of spelled-out names have one surname and cannot be one person's."""
    return F.exists(spelled, lambda x: F.exists(spelled, lambda y: (x["surname"] == y["surname"]) & ~compatible_names(x["given"], y["given"])))


@dataclass
class Names:
    """Distinct names (variant, surname, given, initials, mentions), and their identifiers, institutions and co-authors."""

    variants: DataFrame
    orcids: DataFrame
    institutions: DataFrame
    coauthors: DataFrame


def gather(mentions: DataFrame) -> Names:
    """Names from ``mentions(record, name, orcid, institution)``, a row for each institution of an author of a record.

    A variant is ``surname|given names`` without accents, titles and suffixes. Names without a surname are left out.
    """
    parts = mentions.select("record", name_parts("name").alias("p"), "orcid", "institution")
    key = F.concat_ws("|", "p.surname", F.array_join("p.given", " "))
    rows = parts.where("p.surname <> ''").select("record", key.alias("variant"), F.col("p.surname").alias("surname"), F.col("p.given").alias("given"), F.nullif(F.trim("orcid"), F.lit("")).alias("orcid"), F.nullif(F.trim(F.lower("institution")), F.lit("")).alias("institution"))
    rows = written(rows, "mentions")
    seen = written(rows.select("record", "variant").distinct(), "name-records")
    spelled = F.exists("given", lambda x: F.length(x) > 1)
    facts = rows.groupBy("variant").agg(F.first("surname").alias("surname"), F.first("given").alias("given"))
    variants = written(facts.join(seen.groupBy("variant").agg(F.count("*").alias("mentions")), "variant").withColumn("initials", ~spelled), "variants")
    pairs = lambda c: written(rows.where(F.col(c).isNotNull()).select("variant", c).distinct(), f"name-{c}")
    other = seen.withColumnRenamed("variant", "coauthor")
    beside = written(seen.join(other, "record").where("variant <> coauthor").select("variant", "coauthor").distinct(), "name-coauthors")
    return Names(variants, pairs("orcid"), pairs("institution"), beside)


def _evidence(names: Names, shared: int, block_names: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b, method, ...) of compatible names of one surname, ambiguous initialled names, and oversized surnames."""
    sizes = names.variants.groupBy("surname").agg(F.count("*").alias("n"))
    oversized = sizes.where(F.col("n") > block_names).select("surname", "n")
    usable = written(names.variants.join(oversized.select("surname"), "surname", "left_anti"), "usable-names")

    def meeting(facts: DataFrame, fact: str, least: int, method: str) -> DataFrame:
        own = usable.select("variant", "surname").join(facts, "variant").select("surname", fact, "variant")
        left, right = own.withColumnRenamed("variant", "a"), own.withColumnRenamed("variant", "b")
        met = left.join(right, ["surname", fact]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
        return met.where(F.col("n") >= least).select("a", "b", F.lit(method).alias("method"))

    met = meeting(names.institutions, "institution", 1, "shared_affiliation").unionAll(meeting(names.coauthors, "coauthor", max(shared, 1), "shared_coauthor"))
    met = met.groupBy("a", "b").agg(F.min("method").alias("method"))  # an affiliation counts before a co-author
    facts = lambda k: usable.select(*(F.col(c).alias(f"{'variant' if c == 'variant' else c}{k}") for c in ("variant", "given", "initials", "mentions")))
    links = met.join(facts(1).withColumnRenamed("variant1", "a"), "a").join(facts(2).withColumnRenamed("variant2", "b"), "b").where(compatible_names(F.col("given1"), F.col("given2")))
    links = written(links, "evidence")
    # an initialled name whose evidence points at names that are not compatible with each other stays alone
    toward = links.where("initials1 AND NOT initials2").select(F.col("a").alias("variant"), F.col("given2").alias("given")).unionAll(links.where("initials2 AND NOT initials1").select("b", "given1"))
    several = toward.groupBy("variant").agg(F.collect_set("given").alias("g")).where(F.exists("g", lambda x: F.exists("g", lambda y: ~compatible_names(x, y)))).select("variant")
    several = written(several, "ambiguous")
    free = links.join(several.withColumnRenamed("variant", "a"), "a", "left_anti").join(several.withColumnRenamed("variant", "b"), "b", "left_anti")
    return free, several, oversized


class _Clusters:
    """Current clusters: (variant, cluster), what is known of each cluster, and the merges made."""

    def __init__(self, names: Names, forbidden: DataFrame) -> None:
        own = names.orcids.groupBy("variant").agg(F.array_sort(F.collect_set("orcid")).alias("orcids"))
        spelled = F.when(~F.col("initials"), F.array(F.struct("surname", "given"))).otherwise(F.array().cast("array<struct<surname:string,given:array<string>>>"))
        facts = names.variants.join(own, "variant", "left").select(F.col("variant").alias("cluster"), F.coalesce("orcids", F.array().cast("array<string>")).alias("orcids"), spelled.alias("spelled"))
        self.state = written(facts, "clusters")
        self.label = names.variants.select("variant", F.col("variant").alias("cluster"))
        self.forbidden = forbidden
        self.merges: list[DataFrame] = []
        self.left: list[DataFrame] = []

    def _ends(self, links: DataFrame, one: str, two: str) -> DataFrame:
        """Links between clusters (x, y, other columns) instead of names."""
        at = lambda v, c: self.label.select(F.col("variant").alias(v), F.col("cluster").alias(c))
        return links.join(at(one, "x"), one).join(at(two, "y"), two).where("x <> y")

    def merge(self, links: DataFrame, check_names: bool, check_orcids: bool = True) -> None:
        """Merges along links (a, b, method, rank), of least rank first where they contradict each other."""
        ends = written(self._ends(links, "a", "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "method", "rank"), "links")
        if ends.isEmpty():
            return
        parts = written(graph.components(ends.select(F.col("x").alias("source"), F.col("y").alias("target"), F.lit(1).alias("weight"))).select(F.col("node").alias("cluster"), "component"), "parts")
        known = written(self.state.join(parts, "cluster"), "part-clusters")
        against = written(self._ends(self.forbidden, "a", "b").select("x", "y").distinct(), "against")
        inside = against.join(parts.select(F.col("cluster").alias("x"), F.col("component").alias("p")), "x").join(parts.select(F.col("cluster").alias("y"), F.col("component").alias("q")), "y").where("p = q").select(F.col("p").alias("component")).distinct()
        all_spelled = F.array_distinct(F.flatten(F.collect_list("spelled")))
        about = known.groupBy("component").agg(F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("orcids")))).alias("n_orcids"), all_spelled.alias("spelled"))
        risky = F.lit(False)
        if check_orcids:
            risky = risky | (F.col("n_orcids") > 1)
        if check_names:
            risky = risky | _clash(F.col("spelled"))
        about = about.join(inside.withColumn("barred", F.lit(True)), "component", "left").select("component", "n", (risky | F.col("barred").isNotNull()).alias("contested"))
        about = written(about, "part-facts")
        self.left.append(about.where(F.col("contested") & (F.col("n") > CONTESTED)).select("component", "n"))
        clean = parts.join(about.where("NOT contested"), "component").select("cluster", F.col("component").alias("into"))
        settled = self._settle(parts, about, ends, known, against, check_names, check_orcids)
        moved = written(clean.unionAll(settled), "moved")
        joined = ends.join(moved.select(F.col("cluster").alias("x"), F.col("into").alias("ix")), "x").join(moved.select(F.col("cluster").alias("y"), F.col("into").alias("iy")), "y").where("ix = iy")
        self.merges.append(joined.select(F.col("x").alias("variant"), "method").unionAll(joined.select("y", "method")).distinct())
        self.label = written(self.label.join(moved, "cluster", "left").select("variant", F.coalesce("into", "cluster").alias("cluster")), "labels")
        again = self.state.join(moved, "cluster", "left").withColumn("cluster", F.coalesce("into", "cluster"))
        self.state = written(again.groupBy("cluster").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("orcids")))).alias("orcids"), all_spelled.alias("spelled")), "clusters")

    @staticmethod
    def _settle(parts, about, ends, known, against, check_names: bool, check_orcids: bool) -> DataFrame:
        """(cluster, into) of contradictory components: a link is left out if it would join what must stay apart."""
        hard = about.where(F.col("contested") & (F.col("n") <= CONTESTED)).select("component")
        of = parts.select(F.col("cluster").alias("x"), "component")
        links = ends.join(of, "x").join(hard, "component").select("component", "x", "y", "rank")
        bars = against.unionAll(against.select("y", "x")).groupBy("x").agg(F.collect_set("y").alias("bars")).withColumnRenamed("x", "cluster")
        facts = known.join(hard, "component").join(bars, "cluster", "left").select("component", "cluster", "orcids", "spelled", "bars")

        def settle(links: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
            root = {c: c for c in facts["cluster"]}
            members = {c: {c} for c in root}
            orcids = {c: set(o) for c, o in zip(facts["cluster"], facts["orcids"], strict=True)}
            spelled = {c: {(s["surname"], tuple(s["given"])) for s in x} for c, x in zip(facts["cluster"], facts["spelled"], strict=True)}
            bars = {c: set(() if b is None else b) for c, b in zip(facts["cluster"], facts["bars"], strict=True)}

            def apart(a: str, b: str) -> bool:
                if bars[a] & members[b] or (check_orcids and orcids[a] and orcids[b] and not orcids[a] & orcids[b]):
                    return True
                return check_names and any(s == t and not _fits(g, h) for s, g in spelled[a] for t, h in spelled[b])

            for x, y in links.sort_values(["rank", "x", "y"])[["x", "y"]].itertuples(index=False):
                a, b = sorted((root[x], root[y]))
                if a != b and not apart(a, b):
                    for m in members[b]:
                        root[m] = a
                    for kept in (members, orcids, spelled, bars):
                        kept[a] |= kept.pop(b)
            return pd.DataFrame({"cluster": list(root), "into": list(root.values())})

        return links.groupBy("component").cogroup(facts.groupBy("component")).applyInPandas(settle, "cluster string, into string")


def _fits(a: tuple, b: tuple) -> bool:
    return all(x == y or (1 in (len(x), len(y)) and x[:1] == y[:1]) for x, y in zip(a, b, strict=False))


@dataclass
class People:
    """``authors(variant, person, method)``; ``oversized(surname, n)``; ``ambiguous(variant)``; ``review`` pairs of persons."""

    authors: DataFrame
    oversized: DataFrame
    ambiguous: DataFrame
    review: DataFrame
    unsettled: list[DataFrame]


def disambiguate(mentions: DataFrame, decisions: DataFrame | None = None, shared: int = 1, block_names: int = BLOCK_NAMES, review_clusters: int = 25) -> People:
    """Resolves the names of ``mentions(record, name, orcid, institution)`` to people.

    In this order: one ORCID is one person; compatible names of one surname with a common institution, or ``shared``
    common co-authors, are one; an initialled name goes to the one spelled-out person that it fits, unless both know
    institutions and share none; reviewers' ``same_author`` decisions (decision, a, b) hold against different ORCIDs.
    Nothing joins names that a ``different_author`` decision parts; different ORCIDs and spelled-out names that disagree
    part people too, ORCIDs before names. Decisions give variants. ``method`` is the strongest way by which a name was
    merged. ``review`` lists compatible persons of a surname that stay apart, of the ``review_clusters`` most mentioned.
    """
    spark = mentions.sparkSession
    names = gather(mentions)
    decisions = decisions if decisions is not None else spark.createDataFrame([], "decision string, a string, b string")
    clusters = _Clusters(names, written(decisions.where("decision = 'different_author'").select("a", "b"), "forbidden"))
    lead = names.orcids.groupBy("orcid").agg(F.min("variant").alias("a"))
    by_orcid = names.orcids.join(lead, "orcid").where("a <> variant").select("a", F.col("variant").alias("b"), F.lit("orcid").alias("method"), F.concat_ws("|", "orcid", "variant").alias("rank"))
    clusters.merge(by_orcid, check_names=False, check_orcids=False)  # linked names have an identifier in common
    links, ambiguous, oversized = _evidence(names, shared, block_names)
    place = lambda k, v: F.concat(F.lpad((F.lit(10**12) - F.col(f"mentions{k}")).cast("string"), 13, "0"), F.lit("|"), F.col(v))
    rank = F.concat(F.least(place(1, "a"), place(2, "b")), F.lit("|"), F.greatest(place(1, "a"), place(2, "b")))
    clusters.merge(links.select("a", "b", "method", rank.alias("rank")), check_names=True)
    clusters.merge(_unique(names, clusters, oversized, ambiguous), check_names=True)
    same = decisions.where("decision = 'same_author'").select("a", "b", F.lit("reviewed").alias("method"), F.concat_ws("|", "a", "b").alias("rank"))
    clusters.merge(same, check_names=False, check_orcids=False)
    person = clusters.label.groupBy("cluster").agg(F.min("variant").alias("person"))
    order = F.array_position(F.array(*(F.lit(m) for m in METHODS)), F.col("method"))
    best = spark.createDataFrame([], "variant string, method string")
    for m in clusters.merges:
        best = best.unionAll(m)
    # merges name clusters of their time, each of which is one of its names
    held = best.join(clusters.label, "variant").groupBy("cluster").agg(F.max_by("method", order).alias("method"))
    known = clusters.state.select("cluster", (F.size("orcids") > 0).alias("anchored"))
    authors = clusters.label.join(person, "cluster").join(held, "cluster", "left").join(known, "cluster")
    method = F.when(F.col("anchored") & (F.coalesce("method", F.lit("")) != "reviewed"), "orcid").otherwise(F.coalesce("method", F.lit("single_variant")))
    authors = written(authors.select("variant", "person", method.alias("method"), "cluster"), "authors")
    review = _review(names, clusters, decisions, review_clusters)
    return People(authors.select("variant", "person", "method"), oversized, ambiguous, review, clusters.left)


def _primaries(names: Names, clusters: _Clusters) -> DataFrame:
    """The most mentioned name of every cluster of a surname: (surname, cluster, variant, given, initials, mentions)."""
    rows = names.variants.join(clusters.label, "variant")
    best = F.min(F.struct((-F.col("mentions")).alias("m"), (-F.length("variant")).alias("l"), "variant", "given", "initials")).alias("p")
    return rows.groupBy("surname", "cluster").agg(best, F.sum("mentions").alias("mentions")).select("surname", "cluster", "p.variant", "p.given", "p.initials", "mentions")


def _unique(names: Names, clusters: _Clusters, oversized: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Links from clusters with an initialled name to the only spelled-out one of their surname that it fits."""
    first = written(_primaries(names, clusters).join(oversized.select("surname"), "surname", "left_anti"), "primaries")
    short = first.where("initials").join(ambiguous, "variant", "left_anti").select("surname", F.col("cluster").alias("x"), F.col("variant").alias("a"), F.col("given").alias("ga"), "mentions")
    full = first.where("NOT initials").select("surname", F.col("cluster").alias("y"), F.col("variant").alias("b"), F.col("given").alias("gb"))
    fits = short.join(full, "surname").where((F.col("x") != F.col("y")) & compatible_names(F.col("ga"), F.col("gb")))
    only = fits.groupBy("x").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("y", "a", "b", "mentions"))).where("n = 1")
    places = written(names.institutions.join(clusters.label, "variant").select("cluster", "institution").distinct(), "cluster-institutions")
    knows = places.select("cluster").distinct()
    both = only.join(knows.select(F.col("cluster").alias("x")), "x", "left_semi").join(knows.select(F.col("cluster").alias("y")), "y", "left_semi")
    shared = both.select("x", "y").join(places.select(F.col("cluster").alias("x"), "institution"), "x").join(places.select(F.col("cluster").alias("y"), "institution"), ["y", "institution"]).select("x", "y").distinct()
    apart = both.select("x", "y").join(shared, ["x", "y"], "left_anti")
    rank = F.concat(F.lpad((F.lit(10**12) - F.col("mentions")).cast("string"), 13, "0"), F.lit("|"), F.col("a"))
    return only.join(apart, ["x", "y"], "left_anti").select("a", "b", F.lit("unique_name").alias("method"), rank.alias("rank"))


def _review(names: Names, clusters: _Clusters, decisions: DataFrame, most: int) -> DataFrame:
    """(surname, a, b, mentions): compatible persons that nothing decided, of the most mentioned of each surname."""
    from pyspark.sql import Window

    first = _primaries(names, clusters).join(clusters.state.select("cluster", "orcids"), "cluster")
    top = first.withColumn("k", F.row_number().over(Window.partitionBy("surname").orderBy(F.desc("mentions"), "variant"))).where(F.col("k") <= most)
    side = lambda k, v: top.select("surname", F.col("variant").alias(v), F.col("given").alias(f"g{k}"), F.col("orcids").alias(f"o{k}"), F.col("mentions").alias(f"m{k}"))
    pairs = side(1, "a").join(side(2, "b"), "surname").where("a < b").where(compatible_names(F.col("g1"), F.col("g2")))
    pairs = pairs.where((F.size("o1") == 0) | (F.size("o2") == 0) | F.arrays_overlap("o1", "o2"))
    decided = decisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(decided, ["a", "b"], "left_anti").select("surname", "a", "b", (F.col("m1") + F.col("m2")).alias("mentions"))
