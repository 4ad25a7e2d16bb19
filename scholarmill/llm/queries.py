"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_lsh, fill_in_middle, line_dedup, media, ngram_join, packing, quality, spelling, suffix_array, suffix_automaton, url_filter

#: The tokenizer definition of the registered queries; the operators take any path.
DEFINITION = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.suffix_array_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automaton.substring_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, how many of them go, and the digest of what stays."""
    kept = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(DEFINITION), keep=())


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path(DEFINITION))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time within the month of the events, spread by id."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("fetched", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(page_id * 37 % 41760 as int))"))


def _list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list entries: every event changes the entry of some page's host, every third one that of its parent domain."""
    pages = _table(spark, sf_dir, "pages").where("page_id IS NOT NULL").select("page_id", url_filter.domains_of(url_filter.host_of(F.col("url"))).alias("keys"))
    bounds = pages.agg(F.min("page_id").alias("least"), (F.max("page_id") - F.min("page_id") + 1).alias("n"))
    kind = F.when(F.col("event_type").isin("view", "error"), "abuse").otherwise("policy")
    action = F.when(F.col("event_type").isin("error", "purchase"), "remove").otherwise("add")
    events = _table(spark, sf_dir, "events").crossJoin(F.broadcast(bounds)).select(kind.alias("list"), action.alias("action"), "ts", "event_id", (F.col("least") + F.col("event_id") % F.col("n")).alias("page_id"))
    named = F.when((F.col("event_id") % 3 == 0) & (F.size("keys") > 1), F.get("keys", F.lit(1))).otherwise(F.get("keys", F.lit(0)))
    return events.join(pages, "page_id").select("list", named.alias("key"), "action", "ts")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_captures(spark, sf_dir), _list_entries(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs.select("doc_id", "text"), labels.where(~quality.held_out(F.col("doc_id"))))
    scores = quality.quality_scores(docs, model)
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    payloads = media.read_payloads(media.store_payloads(docs))
    items = media.interleave(docs.select("doc_id", media.page_of(F.col("text")).alias("html")), "doc_id", "html", with_text=False)
    found = media.resolve(items, payloads)
    return found.select("doc_id", "pos", "caption", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and media item of the raw web pages, in order."""
    return media.interleave(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_url_filters": op8_url_filters,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_media_columns": op10_media_columns,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_spelling_variants": op13_spelling_variants,
    "interleaved_pages": interleaved_pages,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, CASE WHEN len(l) >= 5 THEN list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')))
    WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk AS (SELECT a AS root, b AS node FROM both_ways UNION SELECT walk.root, e.b FROM walk JOIN both_ways e ON e.a = walk.node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.component, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT node, min(root) AS component FROM walk GROUP BY node) c ON c.node = s.doc_id
""",
    "op2_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
walk AS (SELECT a AS root, b AS node FROM links UNION SELECT walk.root, l.b FROM walk JOIN links l ON l.a = walk.node),
c AS (SELECT node, min(root) AS component FROM walk GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.component, v.vec_id)) AS component_id,
  least(v.vec_id, coalesce(c.component, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.node = v.vec_id
""",
    "op3_suffix_array_dedup": r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT doc_id, x, unnest(range(0, n - 199)) AS s FROM t),
k AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 400)) AS h FROM i),
d AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS c FROM k) WHERE c > 1),
m AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM d),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM m),
spans AS (SELECT doc_id, min(s) AS b, max(s) + 200 AS e FROM g GROUP BY doc_id, r),
parts AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a, b FROM spans
  UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS y, count(*) - 1 AS n_spans
  FROM parts JOIN t USING (doc_id) GROUP BY t.doc_id)
SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - length(coalesce(y, x)) // 2 AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
""",
    "op4_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT doc_id, l, unnest(range(1, len(l) - 48)) AS i FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 49], ' ')) AS h FROM i),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE first_doc < doc_id),
gone_of AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(l) AS n, CASE WHEN ps IS NULL THEN l ELSE list_transform(list_filter(range(1, len(l) + 1), lambda p: NOT list_contains(ps, p)), lambda p: l[p]) END AS r
  FROM w LEFT JOIN gone_of USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(r) AS BIGINT) AS n_removed, sha256(array_to_string(r, ' ')) AS kept_sha256 FROM kept
""",
    "op8_url_filters": r"""
WITH seen AS (
  SELECT DISTINCT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\.', '') AS host,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id * 37 % 41760 AS BIGINT)) AS at_time
  FROM pages WHERE page_id IS NOT NULL),
labelled AS (SELECT page_id, host, at_time, string_split(host, '.') AS l FROM seen WHERE host <> ''),
looked AS (
  SELECT page_id, at_time, array_to_string(l[i:], '.') AS key
  FROM (SELECT *, unnest(range(1, greatest(len(l), 2))) AS i FROM labelled)),
bounds AS (SELECT min(page_id) AS least, max(page_id) - min(page_id) + 1 AS n FROM pages),
hosts AS (SELECT DISTINCT page_id, host, l FROM labelled),
entries AS (
  SELECT CASE WHEN event_type IN ('view', 'error') THEN 'abuse' ELSE 'policy' END AS list,
         CASE WHEN event_id % 3 = 0 AND len(l) > 2 THEN array_to_string(l[2:], '.') ELSE host END AS key,
         max(CASE WHEN event_type IN ('error', 'purchase') THEN 'remove' ELSE 'add' END) AS action, ts
  FROM events CROSS JOIN bounds JOIN hosts ON hosts.page_id = least + event_id % n
  GROUP BY ALL),
last_change AS (
  SELECT k.page_id, k.key, n.list,
         (SELECT max_by(e.action, e.ts) FROM entries e WHERE e.key = k.key AND e.list = n.list AND e.ts <= k.at_time) AS action
  FROM looked k, (VALUES ('abuse'), ('policy')) n(list)),
verdict AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM last_change WHERE action = 'add' GROUP BY page_id)
SELECT s.page_id, s.host, coalesce(v.n, 0) AS n_entries, coalesce(v.lists, '') AS lists, v.n IS NULL AS allowed
FROM seen s LEFT JOIN verdict v USING (page_id)
""",
    "op11_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l
  FROM documents WHERE doc_id IS NOT NULL),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l
  FROM benchmark WHERE item_id IS NOT NULL),
w AS (
  SELECT DISTINCT item_id, k, array_to_string(l[i:i + k - 1], ' ') AS t
  FROM (SELECT item_id, l, least(len(l), 10) AS k, unnest(range(1, greatest(len(l) - 8, 2))) AS i FROM b WHERE len(l) > 0)),
p AS (SELECT doc_id, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w)),
h AS (SELECT doc_id, i, w.k, item_id FROM (SELECT doc_id, i, k, array_to_string(l[i:i + k - 1], ' ') AS t FROM p) x JOIN w ON w.k = x.k AND w.t = x.t),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
""",
    "op12_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
h AS (
  SELECT *, len(l) AS n, CAST('0x' || substr(k, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(k, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(k, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(k, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
x AS (SELECT doc_id, text, n, form, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM x
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE step AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS c FROM step WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
each_run AS (SELECT doc_id, r, count(*) AS n FROM runs WHERE length(r) >= 5 GROUP BY doc_id, r),
bytes AS (SELECT doc_id, r, n, hex(encode(doc_id || ':' || r)) AS x FROM each_run),
sums AS (
  SELECT doc_id, r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda j: CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT))),
         lambda h, y: xor(c[(xor(h, y) & 255) + 1], h >> 8)), 4294967295) AS h FROM bytes, crc),
words AS (
  SELECT w AS word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w FROM sums)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON b.word = a.d
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON b.word = a.d),
best AS (SELECT word, count(*) AS n_near, max(n) AS m FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN m END AS form_n,
         CASE WHEN m >= 2 * w.n THEN (SELECT min(near) FROM pairs p WHERE p.word = w.word AND p.n = m) END AS form
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at_word, 0 AS k FROM forms
  UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN forms f ON f.word = walk.at_word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, max_by(at_word, k) AS root FROM walk GROUP BY word) USING (word)
""",
}
