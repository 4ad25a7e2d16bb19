"""Records: overlays, upserts, retirement, registry look-ups, interval and ranked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import tagged
from ..operators import merge
from ..registry import query
from ..sources.tables import PUB_SQL, publications, table


@query("corrections_overlay", """SELECT o_orderkey, coalesce(c_name, '') AS name, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'corrected ' || o_orderpriority END, o_orderpriority) AS priority,
  coalesce(CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice + 1 END, o_totalprice) AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'""")
def corrections_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted records with the corrected columns laid over their own."""
    orders = table(spark, folder, "orders").where("o_orderstatus <> 'P'")
    named = orders.join(table(spark, folder, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    corrected = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.concat(F.lit("corrected "), "o_orderpriority").alias("o_orderpriority"), F.when(F.col("o_orderkey") % 9 == 0, F.col("o_totalprice") + 1).alias("o_totalprice"))
    out = merge.overlay(named, corrected, "o_orderkey", ["o_orderpriority", "o_totalprice"])
    return out.select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("name"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.where("o_orderkey % 4 <> 0"), orders.where("o_orderkey % 3 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)


@query("upsert_snapshot", """WITH a AS (SELECT * FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice + 1, a.o_totalprice) AS o_totalprice
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def upsert_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return merge.upsert(*_snapshots(spark, folder), "o_orderkey")


@query("retire_stale", """SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderstatus <> 'P' AS retired FROM orders WHERE o_orderkey % 4 <> 0""")
def retire_stale(spark: SparkSession, folder: str) -> DataFrame:
    """Stored rows that the newest snapshot lacks are retired, but for the exempt ones."""
    stored, newest = _snapshots(spark, folder)
    return merge.retire(stored, newest, "o_orderkey", exempt=F.col("o_orderstatus") == "P").select("o_orderkey", "retired")


@query("canonical_keys", """WITH new AS (SELECT o_orderkey AS new_key, o_custkey AS id1, o_orderkey % 500 AS id2 FROM orders),
old AS (SELECT c_custkey AS old_key, c_custkey AS id1, c_custkey + 1 AS id2 FROM customer),
m AS (SELECT new_key, old_key FROM new JOIN old USING (id1) UNION SELECT new_key, old_key FROM new JOIN old USING (id2))
SELECT new_key, min(old_key) AS old_key, count(*) AS matches, count(*) > 1 AS conflict FROM m GROUP BY new_key""")
def canonical_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A new record takes the key of the stored one that shares any identifier; several stored ones are a conflict."""
    new = table(spark, folder, "orders").select(F.col("o_orderkey").alias("new_key"), F.col("o_custkey").alias("id1"), (F.col("o_orderkey") % 500).alias("id2"))
    old = table(spark, folder, "customer").select(F.col("c_custkey").alias("old_key"), F.col("c_custkey").alias("id1"), (F.col("c_custkey") + 1).alias("id2"))
    return merge.match_any(new, old, "new_key", "old_key", ["id1", "id2"])


@query("registry_lookup", """WITH raw AS (SELECT s_suppkey, 'Dept ' || s_suppkey % 7 || ', ' || n_name || ', ' || r_name AS affiliation, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, lower(n_name) AS alias, n_nationkey AS institution_id, 1 AS pos FROM raw JOIN nation USING (n_name)""")
def registry_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The first comma part of an affiliation that the registry of institutions knows."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    raw = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    raw = raw.select("s_suppkey", F.concat(F.lit("Dept "), (F.col("s_suppkey") % 7).cast("string"), F.lit(", "), "n_name", F.lit(", "), "r_name").alias("affiliation"))
    registry = nation.select(F.lower("n_name").alias("alias"), F.col("n_nationkey").alias("institution_id"))
    return merge.registry_lookup(raw, "s_suppkey", "affiliation", registry)


@query("affiliation_at_time", """WITH spans AS (SELECT c_custkey, c_nationkey AS inst, 1995 + c_custkey % 3 AS since, 1998 + c_custkey % 4 AS until FROM customer)
SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN since AND until THEN inst END AS institution, year(o_orderdate) BETWEEN since AND until AS active FROM orders JOIN spans ON o_custkey = c_custkey""")
def affiliation_at_time(spark: SparkSession, folder: str) -> DataFrame:
    """The affiliation active in a publication's year, by an equi-join with the interval as a further condition."""
    spans = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("inst"), (1995 + F.col("c_custkey") % 3).alias("since"), (1998 + F.col("c_custkey") % 4).alias("until"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    active = F.col("y").between(F.col("since"), F.col("until"))
    return orders.join(spans, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.when(active, F.col("inst")).alias("institution"), active.alias("active"))


@query("profile_stats", """SELECT c_custkey AS profile_id, count(o_orderkey) AS n, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year,
  CAST(coalesce(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)), 0) AS BIGINT) AS citations FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def profile_stats(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"), F.sum(F.floor(F.col("o_totalprice") / 1000)).alias("citations"))
    people = table(spark, folder, "customer").select("c_custkey")
    return people.join(own, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("profile_id"), F.coalesce("n", F.lit(0)).alias("n"), "first_year", "last_year", F.coalesce("citations", F.lit(0)).alias("citations"))


@query("key_overlap", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both_sides, count(*) FILTER (WHERE b.k IS NULL) AS left_only, count(*) FILTER (WHERE a.k IS NULL) AS right_only FROM a FULL JOIN b ON a.k = b.k""")
def key_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """How many keys two sources share, in one aggregation over both."""
    side = F.col("o_orderstatus")
    seen = table(spark, folder, "orders").where(side.isin("F", "P")).groupBy("o_custkey").agg(F.bool_or(side == "F").alias("a"), F.bool_or(side == "P").alias("b"))
    return seen.agg(F.count_if(F.col("a") & F.col("b")).alias("both_sides"), F.count_if(~F.col("b")).alias("left_only"), F.count_if(~F.col("a")).alias("right_only"))


@query("hit_hydration", PUB_SQL + """, hits AS (SELECT row_number() OVER (ORDER BY vec_id) AS hit_rank, 'source:openalex:' || vec_id AS k, '10.1000/' || (vec_id + 1) AS d FROM embeddings WHERE label = 3),
m AS (SELECT hit_rank, 1 AS p, publication_key FROM hits JOIN pub ON publication_key = k UNION ALL SELECT hit_rank, 2, publication_key FROM hits JOIN pub ON doi = d)
SELECT hit_rank, publication_key FROM m QUALIFY row_number() OVER (PARTITION BY hit_rank ORDER BY p, publication_key) = 1""")
def hit_hydration(spark: SparkSession, folder: str) -> DataFrame:
    """Search hits meet their records by the best identifier they share: ranked equi-joins, best match first."""
    ranked = table(spark, folder, "embeddings").where("label = 3").select("vec_id")
    hits = ranked.withColumn("hit_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("vec_id")).cast("long"))  # one page of hits
    hits = hits.select("hit_rank", F.concat(F.lit("source:openalex:"), F.col("vec_id").cast("string")).alias("publication_key"), F.concat(F.lit("10.1000/"), (F.col("vec_id") + 1).cast("string")).alias("doi"))
    pub = publications(spark, folder, "publication_key", "doi")
    return merge.match_best(hits, pub, "hit_rank", "publication_key", ["publication_key", "doi"])


@query("relational_fanout", PUB_SQL + """SELECT 'author' AS entity, count(DISTINCT trim(v)) AS entities, count(*) AS links FROM (SELECT unnest(string_split(authors, ';')) AS v FROM pub) WHERE trim(v) <> ''
UNION ALL SELECT 'institution', count(DISTINCT trim(v)), count(*) FROM (SELECT unnest(string_split(institutions, ';')) AS v FROM pub) WHERE trim(v) <> ''
UNION ALL SELECT 'country', count(DISTINCT trim(v)), count(*) FROM (SELECT unnest(string_split(countries, ';')) AS v FROM pub) WHERE trim(v) <> ''""")
def relational_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts of the entity and link tables that publications fan out into."""
    pub = publications(spark, folder, "authors", "institutions", "countries")
    kinds = [tagged(F.col(c), k, "entity") for k, c in (("author", "authors"), ("institution", "institutions"), ("country", "countries"))]
    return pub.select(F.explode(F.concat(*kinds)).alias("x")).select("x.*").groupBy("entity").agg(F.countDistinct("v").alias("entities"), F.count("*").alias("links"))


@query("public_eligible", """SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND coalesce(CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 'true' ELSE 'false' END, 'false') = 'false'""")
def public_eligible(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted, confident, not waiting for review; an unknown review flag counts as no."""
    waiting = F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderkey") % 10 == 1, "true").otherwise("false")
    return table(spark, folder, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.coalesce(waiting, F.lit("false")) == "false")).select("o_orderkey")


@query("export_jsonl", PUB_SQL + """SELECT publication_key, '{"publication_key":"' || publication_key || '"' || coalesce(',"doi":"' || doi || '"', '') || '}' AS line FROM pub""")
def export_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Publications as JSON lines; unknown values are left out."""
    return publications(spark, folder, "publication_key", "doi").select("publication_key", F.to_json(F.struct("publication_key", "doi")).alias("line"))
