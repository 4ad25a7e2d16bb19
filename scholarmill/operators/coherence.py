"""How good topics are: coherence of their words in the texts, diversity, redundancy, the number of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import written

#: Fixed value: keeps logarithms of impossible pairs finite.
TINY = 1e-12


def window_counts(docs: DataFrame, tokens: str, words: DataFrame, window: int = 110) -> tuple[DataFrame, DataFrame, int]:
    """(word, n), (a, b, n) with a < b, and the number of windows: in how many windows of tokens words stand, and pairs.

    A window is every run of ``window`` tokens of a document, or all of one with fewer; empty documents have none.
    Only places of ``words(word)`` are looked at. Windows are not written out: an occurrence covers the windows that
    start in a range, and the ranges of a word are joined; a pair stands in the parts where the ranges of both meet.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(tokens).alias("t")).where(F.size("t") > 0)
    rows = written(rows.select("doc", F.greatest(F.size("t") - window, F.lit(0)).alias("last"), "t"), "window-docs")
    total = rows.agg(F.coalesce(F.sum(F.col("last") + 1), F.lit(0)).alias("n")).first().n
    places = rows.select("doc", "last", F.posexplode("t").alias("at", "word")).join(words.select("word").distinct(), "word")
    spans = places.select("doc", "word", F.greatest(F.col("at") - window + 1, F.lit(0)).alias("lo"), F.least("at", "last").alias("hi"))
    own = Window.partitionBy("doc", "word").orderBy("lo")
    marked = spans.withColumn("fresh", (F.col("lo") > F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1)) + 1).cast("int"))
    runs = marked.withColumn("run", F.sum(F.coalesce("fresh", F.lit(1))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(runs.groupBy("doc", "word", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "window-runs")
    single = runs.groupBy("word").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))
    one, two = runs.select("doc", F.col("word").alias("a"), F.col("lo").alias("l1"), F.col("hi").alias("h1")), runs.select("doc", F.col("word").alias("b"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
    both = one.join(two, "doc").where("a < b AND l1 <= h2 AND l2 <= h1")
    pairs = both.groupBy("a", "b").agg(F.sum(F.least("h1", "h2") - F.greatest("l1", "l2") + 1).alias("n"))
    return single, pairs, total


def coherence_cv(docs: DataFrame, tokens: str, topic_words: DataFrame, window: int = 110) -> DataFrame:
    """(topic, coherence) of ``topic_words(topic, word)``: how alike its words' company is, by windows of the texts.

    Each word of a topic has a vector of its normalised pointwise information with every word of the topic; the coherence
    is the mean cosine of these vectors with their sum. Words that no text has count with zero. Repeated words count once.
    """
    listed = written(topic_words.select("topic", "word").distinct(), "topic-words")
    single, pairs, total = window_counts(docs, tokens, listed, window)
    single = written(single, "word-windows")
    pairs = written(pairs.unionAll(pairs.select("b", "a", "n")), "pair-windows")
    n = F.lit(float(max(total, 1)))
    grid = listed.withColumnRenamed("word", "a").join(listed.withColumnRenamed("word", "b"), "topic")
    grid = grid.join(single.select(F.col("word").alias("a"), F.col("n").alias("na")), "a", "left").join(single.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b", "left").join(pairs.withColumnRenamed("n", "nab"), ["a", "b"], "left")
    joint = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.coalesce("nab", F.lit(0))) / n
    ratio = (joint + TINY) / (F.col("na") / n * F.col("nb") / n)
    info = F.when(F.col("na").isNull() | F.col("nb").isNull(), 0.0).otherwise(F.log(ratio) / -F.log(joint + TINY))
    vectors = written(grid.select("topic", "a", "b", info.alias("v")), "topic-vectors")
    together = vectors.groupBy("topic", "b").agg(F.sum("v").alias("s"))
    dots = vectors.join(together, ["topic", "b"]).groupBy("topic", "a").agg(F.sum(F.col("v") * F.col("s")).alias("d"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l1"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("l2"))
    cosine = F.when((F.col("l1") > 0) & (F.col("l2") > 0), F.col("d") / (F.col("l1") * F.col("l2"))).otherwise(0.0)
    return dots.groupBy("topic").agg(F.avg(cosine).alias("coherence"))


def diversity(topic_words: DataFrame) -> DataFrame:
    """One row: the share of distinct words among all listed ones; 0 without words."""
    return topic_words.agg(F.coalesce(F.countDistinct("word") / F.nullif(F.count("word"), F.lit(0)), F.lit(0.0)).alias("diversity"))


def redundancy(topic_words: DataFrame) -> DataFrame:
    """One row: the mean share of common words over all pairs of topics; 0 for fewer than two topics.

    Only pairs with a common word are met; the others count with zero.
    """
    listed = topic_words.select("topic", "word").distinct()
    sizes = listed.groupBy("topic").agg(F.count("*").alias("n"))
    a, b = listed.select("word", F.col("topic").alias("a")), listed.select("word", F.col("topic").alias("b"))
    common = a.join(b, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    met = common.join(sizes.select(F.col("topic").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("topic").alias("b"), F.col("n").alias("nb")), "b")
    total = met.agg(F.coalesce(F.sum(F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))), F.lit(0.0)).alias("s"))
    pairs = sizes.agg((F.count("*") * (F.count("*") - 1) / 2).alias("p"))
    return total.crossJoin(pairs).select(F.coalesce(F.col("s") / F.nullif(F.col("p"), F.lit(0.0)), F.lit(0.0)).alias("redundancy"))  # one row each
