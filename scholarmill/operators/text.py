"""Text and vector operators: terms, TF-IDF, prefix search, neighbours, topic figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPLIT = r"[^\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), _SPLIT), lambda w: w != "")


def prefix_search(docs: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """The rows in which every term begins some word, with ``hits``: the words that some term begins."""
    found = docs.withColumn("_words", words(F.col(column)))

    def starting(t: str):
        return lambda w: F.startswith(w, F.lit(t))

    for t in terms:
        found = found.where(F.exists("_words", starting(t)))

    def begins(w: Column) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.startswith(w, F.lit(t))
        return out

    return found.withColumn("hits", F.size(F.filter("_words", begins)).cast("long")).drop("_words")


def vocabulary(docs: DataFrame, text_col: str, least: int, most: float, features: int, shortest: int = 2) -> tuple[DataFrame, int]:
    """(term, df, total) and the number of documents, one a row: terms in ``least`` documents or more and in at most the part ``most``.

    The most frequent come first. A document gives its words and, marked, its distinct words, so that both counts are summed
    by term alone before the shuffle, which then grows with the vocabulary and not with the documents.
    """
    n_docs = docs.count()
    found = F.filter(F.split(F.lower(F.col(text_col)), _SPLIT), lambda w: F.length(w) >= shortest)
    each = docs.select(found.alias("words")).select(F.explode(F.array(F.struct(F.lit(0).alias("df"), F.col("words").alias("w")), F.struct(F.lit(1).alias("df"), F.array_distinct("words").alias("w")))).alias("x"))
    by_term = each.select("x.df", F.explode("x.w").alias("term")).groupBy("term").agg(F.sum("df").alias("df"), F.sum(1 - F.col("df")).alias("total"))
    return by_term.where(F.col("df").between(least, int(most * n_docs))).orderBy(F.desc("total"), F.desc("df"), "term").limit(features), n_docs


def weigh(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(id, columns of ``terms`` but its idf, weight): tf x ``idf`` of the terms (term, idf, ...), of unit length for each id.

    Words outside of the vocabulary go before anything is counted by document; whether it is broadcast is left to its size.
    """
    more = [c for c in terms.columns if c not in ("term", "idf")]
    words_of = docs.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), _SPLIT)).alias("term")).join(terms, "term")
    rows = words_of.groupBy(id_col, "term").agg(F.count("*").alias("tf"), *(F.first(c).alias(c) for c in ("idf", *more))).withColumn("w", F.col("tf") * F.col("idf"))
    rows = rows.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col))))
    return rows.select(id_col, "term", *more, "w", "weight")


def tfidf(docs: DataFrame, id_col: str, text_col: str, least: int, most: float, features: int, top: int | None) -> DataFrame:
    """(id, term, weight, rank): each document's ``top`` terms (None: all) by tf x smoothed idf, weights of unit length.

    A document is one row. The vocabulary has ``features`` rows at most.
    """
    terms, n = vocabulary(docs, text_col, least, most, features)
    terms = terms.withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0).select("term", "idf")
    rows = weigh(docs, id_col, text_col, terms)
    best = Window.partitionBy(id_col).orderBy(F.desc(F.round("w", 9)), "term")
    rows = rows.withColumn("rank", F.row_number().over(best).cast("long"))
    return (rows if top is None else rows.where(F.col("rank") <= top)).select(id_col, "term", "weight", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def search_by_vector(rows: DataFrame, id_col: str, vector_col: str, vector: list[float], limit: int, least: float | None = None) -> DataFrame:
    """The ``limit`` rows of greatest dot product with a vector, as one top-k without a full sort."""
    score = dot(F.col(vector_col), F.array(*(F.lit(float(x)) for x in vector)))
    scored = rows.withColumn("_s", score)
    if least is not None:
        scored = scored.where(F.col("_s") >= least)
    return scored.withColumn("score", F.round("_s", 6)).drop("_s").orderBy(F.desc("score"), id_col).limit(limit)


def related(rows: DataFrame, id_col: str, vector_col: str, key: int, limit: int, least: float | None = None) -> DataFrame:
    """The neighbours of a stored vector; none where the key is not there."""
    own = rows.where(F.col(id_col) == key).select(vector_col).limit(1).collect()  # one vector
    if not own:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    return search_by_vector(rows.where(F.col(id_col) != key), id_col, vector_col, list(own[0][0]), limit, least)


def shares(counts: DataFrame, period: str, topic: str, n: str = "n") -> DataFrame:
    """Counts with their share of the period's total."""
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(period)))


def slopes(series: DataFrame, topic: str, period: str, value: str) -> DataFrame:
    """(topic, slope, correlation, periods, first, last) by least squares over the periods."""
    x, y = F.col(period).cast("double"), F.col(value).cast("double")
    return series.groupBy(topic).agg(F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("correlation"), F.count("*").alias("periods"), F.min_by(value, period).alias("first"), F.max_by(value, period).alias("last"))
