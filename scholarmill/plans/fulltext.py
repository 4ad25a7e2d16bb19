"""Full-text search with stems, an index and a rank by covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import STOP_WORDS, stem_sql, with_stems
from ..operators import fulltext
from ..registry import query
from ..sources.tables import PUB_SQL, publications, table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SPLIT = "[^\\p{L}\\p{N}]+"
_DOC_WORDS = f"t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_SPLIT}'), lambda w: w <> '') AS l FROM documents)"
_WORDS = f"w AS (SELECT id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS place FROM t), dw AS (SELECT DISTINCT word FROM w WHERE word NOT IN ({_STOP}))"


def _covers_sql(words: str, *terms: str) -> str:
    """WITH entries that end in ``ranked(id, covers, rank)``."""
    marks = ", ".join(f"starts_with(stem, '{t}') AS m{k}" for k, t in enumerate(terms))
    some = " OR ".join(f"m{k}" for k in range(len(terms)))
    last = ", ".join(f"max(CASE WHEN m{k} THEN place END) OVER (PARTITION BY id ORDER BY place) AS l{k}" for k in range(len(terms)))
    known = " AND ".join(f"l{k} IS NOT NULL" for k in range(len(terms)))
    least = f"least({', '.join(f'l{k}' for k in range(len(terms)))})"
    return f"""{words}, {_WORDS}, {stem_sql('dw')},
e AS (SELECT * FROM (SELECT id, place, {marks} FROM w JOIN stemmed USING (word)) WHERE {some}),
n AS (SELECT id, place, row_number() OVER (PARTITION BY id ORDER BY place) AS at_row, {last} FROM e),
p AS (SELECT id, place, at_row, {least} AS f FROM n WHERE {known}),
c AS (SELECT id, place, at_row, f FROM p QUALIFY f > coalesce(lag(f) OVER (PARTITION BY id ORDER BY place), -1)),
ranked AS (SELECT c.id, count(*) AS covers, sum(0.1 / (1.0 + (c.place - c.f) - (c.at_row - n.at_row))) AS rank FROM c JOIN n ON n.id = c.id AND n.place = c.f GROUP BY c.id)"""


@query("fulltext_stems", f"WITH {_DOC_WORDS}, {_WORDS}, {stem_sql('dw')} SELECT word, stem FROM stemmed")
def fulltext_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct word of the documents with its stem."""
    words = F.filter(F.split(F.lower("text"), _SPLIT), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return with_stems(table(spark, folder, "documents").select(F.explode(words).alias("word")).distinct())


@query("fulltext_ranked", f"WITH {_covers_sql(_DOC_WORDS, 'tion', 'ment')} SELECT id AS doc_id, covers, round(rank, 9) AS rank FROM ranked")
def fulltext_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with both terms, by the index, with their covers and rank."""
    index = fulltext.build_index(table(spark, folder, "documents"), "doc_id", "text")
    found = fulltext.ranked(index, fulltext.query_terms(spark, "TION, ment"))
    return found.select(F.col("id").alias("doc_id"), "covers", F.round("rank", 9).alias("rank"))


_PUB_WORDS = f"t AS (SELECT publication_key AS id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, authors, institutions, countries, topics, primary_field, doi)), '{_SPLIT}'), lambda w: w <> '') AS l FROM pub)"


@query("publications_relevance", PUB_SQL + ", " + _covers_sql(_PUB_WORDS, "urgent", "studi", "econom") + """
SELECT publication_key, title, publication_year, round(rank, 9) AS rank, (SELECT count(*) FROM ranked) AS total FROM pub JOIN ranked ON id = publication_key
ORDER BY round(rank, 9) DESC, publication_year DESC NULLS LAST, publication_key LIMIT 25 OFFSET 25""")
def publications_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of the publications that match three terms, the most relevant first, then the latest; with the total."""
    columns = ("title", "authors", "institutions", "countries", "topics", "primary_field", "doi")
    pub = publications(spark, folder, "publication_key", "publication_year", *columns)
    index = fulltext.build_index(pub, "publication_key", *columns)
    records = publications(spark, folder, "publication_key", "title", "publication_year")
    page = fulltext.search_page(index, records, "publication_key", "urgent studies Econom", [F.desc_nulls_last("publication_year"), F.col("publication_key")], number=2, size=25)
    return page.select("publication_key", "title", "publication_year", F.round("rank", 9).alias("rank"), "total")
