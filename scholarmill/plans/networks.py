"""Collaboration networks of publications, and the graph figures computed on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import present, split_list
from ..operators import graph
from ..registry import query
from ..sources.tables import PUB_SQL, publications


def pair_edges(pub: DataFrame, column: str, least: int) -> DataFrame:
    """(source, target, weight, first_year, last_year) of values that occur together, in name order.

    Pairs are made within a publication's own list, so that nothing is shuffled before the counts.
    """
    named = pub.select(F.array_sort(F.array_distinct(split_list(F.col(column)))).alias("v"), "publication_year")
    pairs = F.flatten(F.transform("v", lambda a, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    rows = named.where(F.size("v") > 1).select(F.explode(pairs).alias("p"), "publication_year").select("p.*", "publication_year")
    return rows.groupBy("source", "target").agg(F.count("*").alias("weight"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year")).where(F.col("weight") >= least)


def nodes(pub: DataFrame, column: str, edges: DataFrame) -> DataFrame:
    """(label, n) of the values that have an edge."""
    active = edges.select(F.col("source").alias("label")).unionAll(edges.select("target")).distinct()
    counted = pub.select(F.explode(F.array_distinct(split_list(F.col(column)))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counted.join(active, "label", "left_semi")


def _edges_sql(column: str, least: int) -> str:
    return f"""{PUB_SQL}, v AS (SELECT DISTINCT publication_key, publication_year, trim(unnest(string_split({column}, ';'))) AS label FROM pub),
edges AS (SELECT a.label AS source, b.label AS target, count(*) AS weight, min(a.publication_year) AS first_year, max(a.publication_year) AS last_year
  FROM v a JOIN v b ON a.publication_key = b.publication_key AND a.label < b.label GROUP BY ALL HAVING count(*) >= {least})"""


for _name, _column, _least in (("institution", "institutions", 5), ("country", "countries", 1), ("author", "authors", 2), ("topic", "topics", 1)):
    query(f"network_{_name}_edges", _edges_sql(_column, _least) + " SELECT * FROM edges")(lambda spark, folder, c=_column, k=_least: pair_edges(publications(spark, folder, c, "publication_year"), c, k))


def _nodes(column: str, least: int):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        pub = publications(spark, folder, column, "publication_year")
        return nodes(pub, column, pair_edges(pub, column, least))

    return run


for _name, _column, _least in (("institution", "institutions", 5), ("country", "countries", 1)):
    query(f"network_{_name}_nodes", _edges_sql(_column, _least) + " SELECT label, count(*) AS n FROM v WHERE label IN (SELECT source FROM edges UNION SELECT target FROM edges) GROUP BY label")(_nodes(_column, _least))


@query("network_author_id_edges", PUB_SQL + """, z AS (
  SELECT publication_key, unnest(list_zip(string_split(authors, ';'), string_split(author_ids, ';'))) AS p FROM pub),
n AS (SELECT publication_key, coalesce(nullif(trim(p[2]), ''), trim(p[1])) AS node, min(trim(p[1])) AS label FROM z WHERE trim(coalesce(p[1], '')) <> '' GROUP BY ALL)
SELECT a.node AS source, b.node AS target, min(a.label) AS source_label, min(b.label) AS target_label, count(*) AS weight
FROM n a JOIN n b ON a.publication_key = b.publication_key AND a.node < b.node GROUP BY a.node, b.node HAVING count(*) >= 2""")
def network_author_id_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between author ids, zipped with the names by position; a name without an id stands for itself."""
    pub = publications(spark, folder, "authors", "author_ids")
    zipped = F.arrays_zip(F.split("authors", ";").alias("name"), F.split("author_ids", ";").alias("id"))
    pub = pub.select(F.filter(F.transform(zipped, lambda x: F.struct(F.coalesce(F.nullif(F.trim(x["id"]), F.lit("")), F.trim(x["name"])).alias("node"), F.trim(x["name"]).alias("label"))), lambda x: present(x["label"])).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: a["node"] < b["node"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = pub.select(F.explode(F.array_distinct(pairs)).alias("p"))
    return rows.groupBy(F.col("p.a.node").alias("source"), F.col("p.b.node").alias("target")).agg(F.min("p.a.label").alias("source_label"), F.min("p.b.label").alias("target_label"), F.count("*").alias("weight")).where("weight >= 2")


_SELF = "Supplier#000000003"


@query("researcher_coauthors", PUB_SQL + f"""SELECT other AS coauthor, count(DISTINCT publication_key) AS n, max(publication_year) AS last_year
FROM (SELECT publication_key, publication_year, trim(unnest(string_split(authors, ';'))) AS other FROM pub WHERE list_contains(string_split(authors, '; '), '{_SELF}'))
WHERE other <> '{_SELF}' GROUP BY other""")
def researcher_coauthors(spark: SparkSession, folder: str) -> DataFrame:
    pub = publications(spark, folder, "publication_key", "authors", "publication_year").where(F.array_contains(split_list(F.col("authors")), _SELF))
    return pub.select("publication_key", "publication_year", F.explode(split_list(F.col("authors"))).alias("coauthor")).where(F.col("coauthor") != _SELF).groupBy("coauthor").agg(F.countDistinct("publication_key").alias("n"), F.max("publication_year").alias("last_year"))


@query("ego_network", PUB_SQL + f""", v AS (SELECT DISTINCT publication_key, trim(unnest(string_split(authors, ';'))) AS label FROM pub WHERE list_contains(string_split(authors, '; '), '{_SELF}'))
SELECT a.label AS source, b.label AS target, count(*) AS weight FROM v a JOIN v b ON a.publication_key = b.publication_key AND a.label < b.label GROUP BY ALL""")
def ego_network(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between the people of one researcher's publications, the researcher included."""
    pub = publications(spark, folder, "authors", "publication_year").where(F.array_contains(split_list(F.col("authors")), _SELF))
    return pair_edges(pub, "authors", 1).select("source", "target", "weight")


@query("researcher_landscape", PUB_SQL + """, n AS (SELECT label, count(*) AS n FROM (SELECT trim(unnest(string_split(authors, ';'))) AS label FROM pub) WHERE label <> '' GROUP BY label)
SELECT CASE WHEN n = 1 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' WHEN n < 50 THEN '10-49' ELSE '50+' END AS bucket, count(*) AS authors FROM n GROUP BY bucket""")
def researcher_landscape(spark: SparkSession, folder: str) -> DataFrame:
    """How many authors have how many publications."""
    n = publications(spark, folder, "authors").select(F.explode(split_list(F.col("authors"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") < 5, "2-4").when(F.col("n") < 10, "5-9").when(F.col("n") < 50, "10-49").otherwise("50+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("authors"))


@query("landscape_institutions", PUB_SQL + """, a AS (SELECT publication_key, trim(unnest(string_split(authors, ';'))) AS author, institutions FROM pub),
q AS (SELECT author FROM a GROUP BY author HAVING count(*) >= 5),
i AS (SELECT a.author, trim(unnest(string_split(a.institutions, ';'))) AS institution FROM a JOIN q USING (author))
SELECT institution, count(DISTINCT author) AS authors FROM i WHERE institution <> '' GROUP BY institution ORDER BY authors DESC, institution LIMIT 8""")
def landscape_institutions(spark: SparkSession, folder: str) -> DataFrame:
    """The institutions with the most authors of five publications or more."""
    rows = publications(spark, folder, "authors", "institutions").select(F.explode(split_list(F.col("authors"))).alias("author"), "institutions")
    counted = rows.groupBy("author").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set(split_list(F.col("institutions"))))).alias("i")).where("n >= 5")
    return counted.select("author", F.explode("i").alias("institution")).groupBy("institution").agg(F.count("*").alias("authors")).orderBy(F.desc("authors"), "institution").limit(8)


@query("researcher_page_facts", PUB_SQL + """, a AS (SELECT publication_key, publication_year, trim(unnest(string_split(authors, ';'))) AS author, institutions FROM pub),
f AS (SELECT author, count(*) AS n, min(publication_year) AS first_year, max(publication_year) AS last_year FROM a GROUP BY author),
i AS (SELECT author, institution, count(*) AS c FROM (SELECT author, trim(unnest(string_split(institutions, ';'))) AS institution FROM a) WHERE institution <> '' GROUP BY ALL),
m AS (SELECT author, institution FROM i QUALIFY row_number() OVER (PARTITION BY author ORDER BY c DESC, institution) = 1)
SELECT author, n, first_year, last_year, institution FROM f LEFT JOIN m USING (author)""")
def researcher_page_facts(spark: SparkSession, folder: str) -> DataFrame:
    """For every author: publications, years, and the institution that stands with most of them."""
    rows = publications(spark, folder, "authors", "institutions", "publication_year").select(F.explode(split_list(F.col("authors"))).alias("author"), "publication_year", "institutions")
    facts = rows.groupBy("author").agg(F.count("*").alias("n"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"))
    counted = rows.select("author", F.explode(split_list(F.col("institutions"))).alias("institution")).groupBy("author", "institution").agg(F.count("*").alias("c"))
    mode = counted.groupBy("author").agg(F.min_by("institution", F.struct(-F.col("c"), "institution")).alias("institution"))
    return facts.join(mode, "author", "left")


@query("institution_collaborators", PUB_SQL + """SELECT other AS collaborator, count(*) AS n FROM (
  SELECT trim(unnest(string_split(institutions, ';'))) AS other FROM pub WHERE list_contains(string_split(institutions, '; '), 'NATION_3'))
WHERE other <> 'NATION_3' GROUP BY other ORDER BY n DESC, other LIMIT 10""")
def institution_collaborators(spark: SparkSession, folder: str) -> DataFrame:
    items = split_list(F.col("institutions"))
    pub = publications(spark, folder, "institutions").where(F.array_contains(items, "NATION_3"))
    return pub.select(F.explode(items).alias("collaborator")).where("collaborator <> 'NATION_3'").groupBy("collaborator").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "collaborator").limit(10)


_GRAPH = _edges_sql("authors", 3)


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    return pair_edges(publications(spark, folder, "authors", "publication_year"), "authors", 3).select("source", "target", "weight")


@query("degree_strength", _GRAPH + """, s AS (SELECT source AS node, weight FROM edges UNION ALL SELECT target, weight FROM edges)
SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength, count(*) / (SELECT count(DISTINCT node) - 1.0 FROM s) AS centrality FROM s GROUP BY node""")
def degree_strength(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(_graph(spark, folder))


@query("graph_components", (_GRAPH + """, s AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
walk AS (SELECT a AS node, a AS root FROM s UNION SELECT s.b, walk.root FROM walk JOIN s ON s.a = walk.node AND walk.root < s.b)
SELECT node, min(root) AS component FROM (SELECT node, root FROM walk UNION SELECT DISTINCT a, a FROM s) GROUP BY node""").replace("WITH lists", "WITH RECURSIVE lists", 1))
def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(_graph(spark, folder))


@query("graph_density", _GRAPH + """, s AS (SELECT source AS node FROM edges UNION SELECT target FROM edges)
SELECT (SELECT count(*) FROM s) AS nodes, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight, 2.0 * count(*) / nullif((SELECT count(*) * (count(*) - 1) FROM s), 0) AS density FROM edges""")
def graph_density(spark: SparkSession, folder: str) -> DataFrame:
    return graph.summary(_graph(spark, folder))


@query("graph_centrality")
def graph_centrality(spark: SparkSession, folder: str) -> DataFrame:
    """Betweenness and closeness of the author network."""
    return graph.path_centrality(_graph(spark, folder))


@query("graph_communities")
def graph_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the author network by weighted label propagation."""
    return graph.communities(_graph(spark, folder))


@query("graph_modularity")
def graph_modularity(spark: SparkSession, folder: str) -> DataFrame:
    edges = _graph(spark, folder)
    return graph.modularity(edges, graph.communities(edges))


@query("edge_share_of_strength", _GRAPH + """, s AS (SELECT source AS node, target AS other, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)
SELECT node, other, weight, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY node) AS part FROM s QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) <= 3""")
def edge_share_of_strength(spark: SparkSession, folder: str) -> DataFrame:
    """Each node's three strongest partners and their part of its weight."""
    both = graph.symmetric(_graph(spark, folder))
    own = Window.partitionBy("node")
    return both.withColumn("part", F.col("weight").cast("double") / F.sum("weight").over(own)).withColumn("k", F.row_number().over(own.orderBy(F.desc("weight"), "other"))).where("k <= 3").drop("k")
