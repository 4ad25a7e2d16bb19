"""Entity resolution: fuzzy pairs within blocks, author clusters."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import split_list
from ..functions.names import compatible, name_parts
from . import graph


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def fuzzy_pairs(rows: DataFrame, key: str, column: str, block: str, least: float, most: int = 100) -> DataFrame:
    """(left, right, score) of pairs within a block with a similarity of ``least`` or more.

    Equal texts are one before pairing. Blocks of more than ``most`` different texts are paired within finer blocks, by
    the texts' lengths, neighbours included: a similarity of ``least`` bounds the ratio of lengths.
    """
    distinct = rows.where(F.length(column) > 0).groupBy(block, column).agg(F.min(key).alias(key))
    size = distinct.groupBy(block).agg(F.count("*").alias("_n"))
    sized = distinct.join(size, block)
    step = F.log(F.lit((2 - least) / least))
    cell = F.when(F.col("_n") > most, F.floor(F.log(F.length(column).cast("double")) / step)).otherwise(0)
    left = sized.select(F.col(block).alias("b"), cell.alias("c"), F.col(key).alias("left"), F.col(column).alias("x"))
    near = sized.select(F.col(block).alias("b"), F.explode(F.when(F.col("_n") > most, F.array(cell - 1, cell, cell + 1)).otherwise(F.array(cell))).alias("c"), F.col(key).alias("right"), F.col(column).alias("y"))
    lengths = 2 * F.least(F.length("x"), F.length("y")) >= least * (F.length("x") + F.length("y"))
    pairs = left.join(near, ["b", "c"]).where((F.col("left") < F.col("right")) & lengths)
    return pairs.withColumn("score", ratio("x", "y")).where(F.col("score") >= least).select("left", "right", "score")


def author_clusters(pub: DataFrame, shared: int = 2) -> DataFrame:
    """(name, person): names resolved to people.

    Names with one identifier are one person. Names of one surname with compatible given names are, too, where they
    share ``shared`` co-authors or more. ``person`` is the smallest name of the cluster.
    """
    zipped = F.arrays_zip(F.split("authors", ";").alias("n"), F.split("author_ids", ";").alias("i"))
    rows = pub.select("publication_key", F.explode(zipped).alias("x")).select("publication_key", F.trim("x.n").alias("name"), F.nullif(F.trim("x.i"), F.lit("")).alias("id")).where("name <> ''")
    by_id = rows.where("id IS NOT NULL").select("name", F.concat(F.lit("\x01"), "id").alias("id")).distinct()
    names = rows.select("name").distinct().withColumn("p", name_parts("name")).select("name", "p.surname", "p.given")
    variants = names.where(F.size("given") > 0)
    a, b = variants.select("surname", F.col("name").alias("a"), F.col("given").alias("ga")), variants.select("surname", F.col("name").alias("b"), F.col("given").alias("gb"))

    @F.pandas_udf("boolean")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([compatible(list(p), list(q)) for p, q in zip(x, y, strict=True)])

    pairs = a.join(b, "surname").where(F.col("a") < F.col("b")).where(agree("ga", "gb")).select("a", "b")
    beside = pub.select(F.array_distinct(split_list(F.col("authors"))).alias("v")).select(F.explode("v").alias("name"), "v").select("name", F.explode("v").alias("co")).where("name <> co").distinct()
    common = pairs.join(beside.select(F.col("name").alias("a"), "co"), "a").join(beside.select(F.col("name").alias("b"), "co"), ["b", "co"])
    linked = common.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= shared)
    edges = by_id.select(F.col("name").alias("source"), F.col("id").alias("target"), F.lit(1).alias("weight")).unionAll(linked.select("a", "b", F.lit(1)))
    groups = graph.components(edges).where(~F.startswith("node", F.lit("\x01")))
    person = groups.groupBy("component").agg(F.min("node").alias("person"))
    known = groups.join(person, "component").select(F.col("node").alias("name"), "person")
    return names.select("name").join(known, "name", "left").select("name", F.coalesce("person", "name").alias("person"))
