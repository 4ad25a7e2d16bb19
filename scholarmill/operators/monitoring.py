"""Drift of a collection from month to month in seven dimensions, as a long table of measures with alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import present, split_list
from ..sources.work import written

#: When a change is an alert (points, parts, or percent).
RATE_POINTS, PSI, MEAN_DELTA, HIGH_POINTS, LENGTH_PERCENT, ABSTRACT_POINTS = 15.0, 0.15, 0.10, 20.0, 30.0, 15.0
DISAGREEMENT_RATE, DISAGREEMENT_POINTS, DECISIONS, SOURCE_POINTS = 15.0, 10.0, 5, 20.0
INSTITUTION_POINTS, CONCENTRATION, CONCENTRATION_ROWS, MISSING_POINTS = 15.0, 80.0, 10, 10.0
#: Fixed value: the least share that counts in the stability index.
LEAST_SHARE = 0.0001
#: Names of sources and what their datasets are called.
SOURCES = (("OpenAlex", "openalex"), ("Crossref", "crossref"), ("SLJOL", "sljol"), ("Repositories", "repositor"))


def rounded(x: Column, digits: int) -> Column:
    """``x`` as a double to so many decimals, as databases round: the shifted double to the nearest whole, halves away from zero."""
    return F.round(x.cast("double") * 10.0**digits, 0) / 10.0**digits


def percent(part: Column, whole: Column) -> Column:
    """Percent with two decimals, 0 over nothing."""
    return F.coalesce(rounded(part / F.nullif(whole, F.lit(0)) * 100, 2), F.lit(0.0))


def month_figures(records: DataFrame) -> DataFrame:
    """One row for each month of ``records(month, label, p, title, abstract, doi, institutions, source, decision)``."""
    words = lambda c: F.size(F.filter(F.split(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != ""))
    overturned = lambda label, decision: F.count_if((F.col("label") == label) & (F.col("decision") == decision))
    p = F.col("p")
    return records.groupBy("month").agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == "AI").alias("ai"), F.count_if(F.col("label") == "NON_AI").alias("non_ai"), F.count_if(F.col("label") == "REVIEW").alias("review"),
        F.avg("p").alias("mean_p"), F.percentile("p", F.lit(0.5)).alias("median_p"), F.stddev_samp("p").alias("std_p"), F.count_if(p < 0.4).alias("low"), F.count_if((p >= 0.4) & (p < 0.66)).alias("mid"), F.count_if(p >= 0.66).alias("high"),
        F.avg(words("title")).alias("title_words"), F.avg(F.when(present(F.col("abstract")), words("abstract"))).alias("abstract_words"), F.count_if(present(F.col("abstract"))).alias("with_abstract"),
        F.count("decision").alias("decisions"), overturned("AI", "human_rejected").alias("fp"), overturned("NON_AI", "human_accepted").alias("fn"),
        *(F.count_if(F.lower("source").contains(part)).alias(f"source_{k}") for k, (_, part) in enumerate(SOURCES)),
        F.count_if(~present(F.col("abstract"))).alias("no_abstract"), F.count_if(~present(F.col("doi"))).alias("no_doi"), F.count_if(~present(F.col("institutions"))).alias("no_institution"),
    )


def drift(records: DataFrame, top: int = 10) -> DataFrame:
    """(month, dimension, measure, previous, current, delta, alert): every month against the last one before it with records.

    Columns of ``records`` as in ``month_figures``; ``decision`` is null without a reviewer's. The first month has no
    previous values and, but for disagreement and concentration, no alerts. Institutions are each month's ``top`` ones by
    records. A stability index is its own delta.
    """
    months = written(month_figures(records), "months")
    order = Window.orderBy("month")  # one row a month
    both = months.select("month", F.struct(*(c for c in months.columns if c != "month")).alias("c")).withColumn("b", F.lag("c").over(order))
    known = F.col("b").isNotNull()
    now, was = (lambda c: F.col(f"c.{c}")), (lambda c: F.col(f"b.{c}"))
    rate = lambda c: (F.when(known, percent(was(c), was("total"))), percent(now(c), now("total")))
    figure = lambda c, digits: (F.when(known, rounded(F.coalesce(was(c), F.lit(0.0)), digits)), rounded(F.coalesce(now(c), F.lit(0.0)), digits))
    rows: dict[str, list[Column]] = {}

    def row(dimension: str, measure: str, values: tuple[Column, Column], alert, digits: int = 2, delta: Column | None = None) -> None:
        change = rounded(values[1] - values[0], digits) if delta is None else delta
        flag = F.coalesce(alert(change), F.lit(False)) if alert else F.lit(False)
        rows.setdefault(dimension, []).append(F.struct(F.lit(dimension).alias("dimension"), F.lit(measure).alias("measure"), values[0].cast("double").alias("previous"), values[1].cast("double").alias("current"), change.cast("double").alias("delta"), flag.alias("alert")))

    beyond = lambda limit: lambda d: F.abs(d) >= limit
    shares = [tuple(F.greatest(x / 100, F.lit(LEAST_SHARE)) for x in rate(c)) for c in ("ai", "non_ai", "review")]
    index = sum(((b - a) * F.log(b / a) for a, b in shares), F.lit(0.0))
    row("prediction", "ai_rate", rate("ai"), beyond(RATE_POINTS))
    row("prediction", "non_ai_rate", rate("non_ai"), None)
    row("prediction", "review_rate", rate("review"), None)
    row("prediction", "psi", (F.lit(None), rounded(F.when(known, index), 4)), lambda d: d >= PSI, delta=rounded(F.when(known, index), 4))
    row("confidence", "mean_p", figure("mean_p", 4), beyond(MEAN_DELTA), 4)
    row("confidence", "median_p", figure("median_p", 4), None, 4)
    row("confidence", "std_p", figure("std_p", 4), None, 4)
    row("confidence", "low", rate("low"), None)
    row("confidence", "medium", rate("mid"), None)
    row("confidence", "high", rate("high"), beyond(HIGH_POINTS))
    for c in ("title_words", "abstract_words"):
        shift = F.coalesce(rounded((F.coalesce(now(c), F.lit(0.0)) - was(c)) / F.nullif(was(c), F.lit(0.0)) * 100, 1), F.when(known, F.lit(0.0)))
        row("feature", c, figure(c, 1), beyond(LENGTH_PERCENT), delta=shift)
    row("feature", "abstract_presence", rate("with_abstract"), lambda d: d <= -ABSTRACT_POINTS)
    disagreement = F.when(known, percent(was("fp") + was("fn"), was("decisions"))), percent(now("fp") + now("fn"), now("decisions"))
    row("human_disagreement", "decisions", (was("decisions"), now("decisions")), None)
    row("human_disagreement", "rate", disagreement, lambda d: ((now("decisions") >= DECISIONS) & (disagreement[1] >= DISAGREEMENT_RATE)) | ((was("decisions") >= DECISIONS) & F.coalesce(d >= DISAGREEMENT_POINTS, F.lit(False))))
    for k, (name, _) in enumerate(SOURCES):
        row("source", name, rate(f"source_{k}"), beyond(SOURCE_POINTS))
    for name, c in (("abstract", "no_abstract"), ("doi", "no_doi"), ("institution", "no_institution")):
        row("missing_data", name, rate(c), lambda d: d >= MISSING_POINTS)
    # a dimension at a time, so that each has code of a size that is compiled
    parts = [both.select("month", F.explode(F.array(*few)).alias("x")).select("month", "x.*") for few in rows.values()]
    plain = parts[0]
    for part in parts[1:]:
        plain = plain.unionAll(part)

    named = records.select("month", F.explode(F.array_distinct(split_list(F.col("institutions")))).alias("measure")).groupBy("month", "measure").agg(F.count("*").alias("n"))
    named = written(named, "month-institutions")
    spread = both.select("month", F.col("c.total").alias("total"), F.lag("month").over(order).alias("before"), F.col("b.total").alias("total_before"))
    first = Window.partitionBy("month").orderBy(F.desc("n"), "measure")
    best = named.withColumn("k", F.row_number().over(first)).where(F.col("k") <= top)
    old = named.select(F.col("month").alias("before"), "measure", F.col("n").alias("m"))
    shown = best.join(spread, "month").join(old, ["before", "measure"], "left")
    a, b = F.when(F.col("before").isNotNull(), percent(F.coalesce("m", F.lit(0)), F.col("total_before"))), percent(F.col("n"), F.col("total"))
    change = rounded(b - a, 2)
    institutions = shown.select("month", F.lit("institution").alias("dimension"), "measure", a.alias("previous"), b.alias("current"), change.alias("delta"), F.coalesce(F.abs(change) >= INSTITUTION_POINTS, F.lit(False)).alias("alert"))
    three = best.where("k <= 3").groupBy("month").agg(F.sum("n").alias("t"))
    held = spread.join(three, "month", "left").join(three.select(F.col("month").alias("before"), F.col("t").alias("u")), "before", "left")
    a, b = F.when(F.col("before").isNotNull(), percent(F.coalesce("u", F.lit(0)), F.col("total_before"))), percent(F.coalesce("t", F.lit(0)), F.col("total"))
    top3 = held.select("month", F.lit("institution").alias("dimension"), F.lit("top3_concentration").alias("measure"), a.alias("previous"), b.alias("current"), rounded(b - a, 2).alias("delta"), ((b >= CONCENTRATION) & (F.col("total") >= CONCENTRATION_ROWS)).alias("alert"))
    return plain.unionAll(institutions).unionAll(top3)
