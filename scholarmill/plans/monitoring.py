"""Drift of publications from month to month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitoring
from ..registry import query
from ..sources.tables import PUB_SQL, publications


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Publications with a score by their key that drifts with the year, texts, and some reviewers' decisions."""
    pub = publications(spark, folder, "publication_key", "publication_date", "title", "doi", "institutions", "source_dataset")
    k = F.element_at(F.split("publication_key", ":"), -1).cast("long")
    p = (k * 7919 % 1000) / 1000.0 * (F.month("publication_date") / 24.0 + 0.5)
    rows = pub.select(F.date_trunc("month", "publication_date").cast("date").alias("month"), k.alias("k"), p.alias("p"), "title", "doi", "institutions", F.col("source_dataset").alias("source"))
    label = F.when(F.col("p") >= 0.66, "AI").when(F.col("p") < 0.4, "NON_AI").otherwise("REVIEW")
    abstract = F.when(F.col("k") % 6 != 0, F.repeat(F.lit("word "), (F.col("k") % 40 + F.month("month")).cast("int")))
    decision = F.when(F.col("k") % 8 == 0, F.when(F.col("k") % 3 == 0, "human_rejected").otherwise("human_accepted"))
    return rows.select("month", label.alias("label"), "p", "title", abstract.alias("abstract"), "doi", "institutions", "source", decision.alias("decision"))


_PCT = "coalesce(round({0} / nullif({1}, 0) * 100, 2), 0)"


def _rate(measure: str, dimension: str, column: str, alert: str) -> str:
    a, b = "CASE WHEN bt IS NOT NULL THEN " + _PCT.format(f"CAST(b_{column} AS DOUBLE)", "bt") + " END", _PCT.format(f"CAST({column} AS DOUBLE)", "total")
    return f"SELECT month, '{dimension}' AS dimension, '{measure}' AS measure, {a} AS previous, {b} AS current, round({b} - {a}, 2) AS delta, coalesce({alert.format(d=f'round({b} - {a}, 2)')}, FALSE) AS alert FROM l"


def _figure(measure: str, dimension: str, digits: int, alert: str, shift: bool = False) -> str:
    a, b = f"CASE WHEN bt IS NOT NULL THEN round(coalesce(b_{measure}, 0), {digits}) END", f"round(coalesce({measure}, 0), {digits})"
    d = f"coalesce(round((coalesce({measure}, 0) - b_{measure}) / nullif(b_{measure}, 0) * 100, 1), CASE WHEN bt IS NOT NULL THEN 0 END)" if shift else f"round({b} - {a}, {digits})"
    return f"SELECT month, '{dimension}', '{measure}', {a}, {b}, {d}, coalesce({alert.format(d=d)}, FALSE) FROM l"


_COLUMNS = ("ai", "non_ai", "review", "low", "mid", "high", "with_abstract", "s0", "s1", "s2", "s3", "no_abstract", "no_doi", "no_inst", "decisions", "fp", "fn", "mean_p", "median_p", "std_p", "title_words", "abstract_words")
_BEYOND = "abs({{d}}) >= {0}"
_PSI = " + ".join(f"(greatest({_PCT.format(f'CAST({c} AS DOUBLE)', 'total')} / 100, 0.0001) - greatest({_PCT.format(f'CAST(b_{c} AS DOUBLE)', 'bt')} / 100, 0.0001)) * ln(greatest({_PCT.format(f'CAST({c} AS DOUBLE)', 'total')} / 100, 0.0001) / greatest({_PCT.format(f'CAST(b_{c} AS DOUBLE)', 'bt')} / 100, 0.0001))" for c in ("ai", "non_ai", "review"))
_DIS_A, _DIS_B = "CASE WHEN bt IS NOT NULL THEN coalesce(round(CAST(b_fp + b_fn AS DOUBLE) / nullif(b_decisions, 0) * 100, 2), 0) END", "coalesce(round(CAST(fp + fn AS DOUBLE) / nullif(decisions, 0) * 100, 2), 0)"

_SQL = PUB_SQL + f""", r0 AS (
  SELECT CAST(date_trunc('month', publication_date) AS DATE) AS month, CAST(string_split(publication_key, ':')[3] AS BIGINT) AS k, title, doi, institutions, lower(source_dataset) AS source, publication_date FROM pub),
r1 AS (SELECT *, (k * 7919 % 1000) / 1000.0 * (month(publication_date) / 24.0 + 0.5) AS p, CASE WHEN k % 6 <> 0 THEN CAST(k % 40 + month(publication_date) AS INTEGER) END AS aw, CASE WHEN k % 8 = 0 THEN CASE WHEN k % 3 = 0 THEN 'human_rejected' ELSE 'human_accepted' END END AS decision FROM r0),
r AS (SELECT *, CASE WHEN p >= 0.66 THEN 'AI' WHEN p < 0.4 THEN 'NON_AI' ELSE 'REVIEW' END AS label FROM r1),
m AS (SELECT month, count(*) AS total, count(*) FILTER (WHERE label = 'AI') AS ai, count(*) FILTER (WHERE label = 'NON_AI') AS non_ai, count(*) FILTER (WHERE label = 'REVIEW') AS review, avg(CAST(p AS DOUBLE)) AS mean_p, median(CAST(p AS DOUBLE)) AS median_p, stddev_samp(CAST(p AS DOUBLE)) AS std_p,
  count(*) FILTER (WHERE p < 0.4) AS low, count(*) FILTER (WHERE p >= 0.4 AND p < 0.66) AS mid, count(*) FILTER (WHERE p >= 0.66) AS high, avg(len(string_split(title, ' '))) AS title_words, avg(aw) AS abstract_words, count(aw) AS with_abstract, count(decision) AS decisions,
  count(*) FILTER (WHERE label = 'AI' AND decision = 'human_rejected') AS fp, count(*) FILTER (WHERE label = 'NON_AI' AND decision = 'human_accepted') AS fn, count(*) FILTER (WHERE contains(source, 'openalex')) AS s0, count(*) FILTER (WHERE contains(source, 'crossref')) AS s1, count(*) FILTER (WHERE contains(source, 'sljol')) AS s2, count(*) FILTER (WHERE contains(source, 'repositor')) AS s3,
  count(*) FILTER (WHERE aw IS NULL) AS no_abstract, count(*) FILTER (WHERE trim(coalesce(doi, '')) = '') AS no_doi, count(*) FILTER (WHERE coalesce(institutions, '') = '') AS no_inst FROM r GROUP BY month),
l AS (SELECT *, lag(month) OVER o AS before, lag(total) OVER o AS bt, {', '.join(f'lag({c}) OVER o AS b_{c}' for c in _COLUMNS)} FROM m WINDOW o AS (ORDER BY month)),
i AS (SELECT month, unnest(list_distinct(string_split(institutions, '; '))) AS measure FROM r WHERE institutions <> ''),
n AS (SELECT month, measure, count(*) AS n FROM i GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, measure) AS k FROM n QUALIFY k <= 10),
t AS (SELECT month, sum(n) FILTER (WHERE k <= 3) AS t FROM best GROUP BY month),
z AS (SELECT b.month, b.measure, CASE WHEN l.before IS NOT NULL THEN {_PCT.format('CAST(coalesce(o.n, 0) AS DOUBLE)', 'l.bt')} END AS a, {_PCT.format('CAST(b.n AS DOUBLE)', 'l.total')} AS c FROM best b JOIN l ON l.month = b.month LEFT JOIN n o ON o.month = l.before AND o.measure = b.measure),
y AS (SELECT l.month, l.total, CASE WHEN l.before IS NOT NULL THEN {_PCT.format('CAST(coalesce(u.t, 0) AS DOUBLE)', 'l.bt')} END AS a, {_PCT.format('CAST(coalesce(t.t, 0) AS DOUBLE)', 'l.total')} AS c FROM l LEFT JOIN t ON t.month = l.month LEFT JOIN t u ON u.month = l.before)
""" + " UNION ALL ".join([
    _rate("ai_rate", "prediction", "ai", _BEYOND.format(15)), _rate("non_ai_rate", "prediction", "non_ai", "FALSE"), _rate("review_rate", "prediction", "review", "FALSE"),
    f"SELECT month, 'prediction', 'psi', NULL, CASE WHEN bt IS NOT NULL THEN round({_PSI}, 4) END, CASE WHEN bt IS NOT NULL THEN round({_PSI}, 4) END, coalesce(bt IS NOT NULL AND round({_PSI}, 4) >= 0.15, FALSE) FROM l",
    _figure("mean_p", "confidence", 4, _BEYOND.format(0.10)), _figure("median_p", "confidence", 4, "FALSE"), _figure("std_p", "confidence", 4, "FALSE"), _rate("low", "confidence", "low", "FALSE"), _rate("medium", "confidence", "mid", "FALSE"), _rate("high", "confidence", "high", _BEYOND.format(20)),
    _figure("title_words", "feature", 1, _BEYOND.format(30), True), _figure("abstract_words", "feature", 1, _BEYOND.format(30), True), _rate("abstract_presence", "feature", "with_abstract", "{d} <= -15"),
    "SELECT month, 'human_disagreement', 'decisions', b_decisions, decisions, decisions - b_decisions, FALSE FROM l",
    f"SELECT month, 'human_disagreement', 'rate', {_DIS_A}, {_DIS_B}, round({_DIS_B} - {_DIS_A}, 2), coalesce(decisions >= 5 AND {_DIS_B} >= 15, FALSE) OR coalesce(b_decisions >= 5 AND round({_DIS_B} - {_DIS_A}, 2) >= 10, FALSE) FROM l",
    *(_rate(name, "source", f"s{k}", _BEYOND.format(20)) for k, name in enumerate(("OpenAlex", "Crossref", "SLJOL", "Repositories"))),
    *(_rate(name, "missing_data", c, "{d} >= 10") for name, c in (("abstract", "no_abstract"), ("doi", "no_doi"), ("institution", "no_inst"))),
    "SELECT month, 'institution', measure, a, c, round(c - a, 2), coalesce(abs(round(c - a, 2)) >= 15, FALSE) FROM z",
    "SELECT month, 'institution', 'top3_concentration', a, c, round(c - a, 2), c >= 80 AND total >= 10 FROM y",
])


@query("drift_report", _SQL)
def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    """Seven dimensions of drift for every month against the one before."""
    return monitoring.drift(_records(spark, folder))
