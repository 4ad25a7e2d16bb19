"""Benchmark decontamination by winnowing: which words of documents stand in passages of benchmark items.

Of every ``window`` consecutive words the k-grams of least hash are fingerprints, on both sides, so that a window that a
document shares with an item always gives both the same fingerprint at the same place of the window. Fingerprints are
joined and every hit is extended over the words around it, which are compared as text. Items of fewer words have one
fingerprint, of all their words, which is looked for at every place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, IS_MARK, Rolling, materialise, mix64, slices, small_batches, utf8, words_of
from .repeats import _sliding

#: Words of a fingerprint.
GRAM = 5
#: Bits of the table of benchmark fingerprints that goes to every task (2 MB), whatever the size of the benchmark.
BITS = 1 << 24
_BLOCK = 32768  # bits of one bitmap of Spark's bitmap functions: a fixed value
_SALT = np.uint64(0x9E3779B97F4A7C15)
_FOUND = "t long, n_words long, h long, at long, size int, before array<string>, after array<string>"


def _winnow(words: np.ndarray, first: np.ndarray, window: int, gram: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the k-grams that are the least of some window of one text."""
    n = len(words)
    has = np.flatnonzero(np.diff(first) >= window)
    if not len(has):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(n - gram + 1)
    grams = mix64(rolling.of(rolling.sums(words), place, place + gram)) | np.uint64(1)
    w = window - gram + 1
    least = _sliding(grams, w, np.minimum)
    inside = np.zeros(n - window + 2, np.int32)
    np.add.at(inside, first[has], 1)
    np.add.at(inside, first[has + 1] - window + 1, -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    edge = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(grams == _sliding(np.concatenate([edge, least, edge]), w, np.maximum)[: len(grams)])
    return chosen, grams[chosen]


def _all_grams(words: np.ndarray, first: np.ndarray, size: int, rolling: Rolling, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every run of ``size`` words of one text, or of the texts that have just so many."""
    counts = np.diff(first)
    if whole:
        place = first[:-1][counts == size]
    else:
        counts = np.maximum(counts - size + 1, 0)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return place, mix64(rolling.of(rolling.sums(words), place, place + size) + np.uint64(size) * _SALT)


def _fingerprints(window: int, gram: int, shorter: list[int], whole: bool, table=None):
    """For (id, t, text) rows: a row with the number of words of each text, and one for each fingerprint that ``table`` knows.

    A fingerprint comes with its place, the words before it (the nearest first) and its own and further words, as many
    as a window around it can hold.
    """

    def run(batches):
        rolling = Rolling()
        known = np.frombuffer(table.value, np.uint8) if table is not None else None
        for batch in batches:
            t = batch.column(1).to_numpy(zero_copy_only=False)
            buf, off = utf8(batch.column(2))
            for lo, hi in slices(off):
                part, bounds = _LOWER[buf[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
                start, end, words, first = words_of(part, bounds, rolling, False, IS_MARK)
                none = [None] * (hi - lo)
                yield _rows(batch.column(0).slice(lo, hi - lo), t[lo:hi], np.diff(first), none, none, 0, none, none)
                data = part.tobytes()
                word = lambda i: data[start[i] : end[i]].decode()  # noqa: B023, E731
                kinds = [(gram, window - gram, *_winnow(words, first, window, gram, rolling))]
                kinds += [(size, 0, *_all_grams(words, first, size, rolling, whole)) for size in shorter]
                for size, reach, place, hashes in kinds:
                    if known is not None:
                        bit = hashes & np.uint64(BITS - 1)
                        on = (known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        place, hashes = place[on], hashes[on]
                    if not len(place):
                        continue
                    text = np.searchsorted(first, place, side="right") - 1
                    spans = list(zip(place.tolist(), first[text].tolist(), first[text + 1].tolist(), strict=True))
                    before = [[word(i) for i in range(p - 1, max(p - reach, a) - 1, -1)] for p, a, _ in spans]
                    after = [[word(i) for i in range(p, min(p + size + reach, b))] for p, _, b in spans]
                    kind = size if reach == 0 else 0
                    yield _rows(batch.column(0).take(pa.array(lo + text)), t[lo + text], [None] * len(place), hashes.view(np.int64), place - first[text], kind, before, after)

    return run


def _rows(ids: pa.Array, t, n_words, h, at, kind: int, before, after) -> pa.RecordBatch:
    long, texts = pa.int64(), pa.list_(pa.string())
    columns = [ids, pa.array(t, long), pa.array(n_words, long), pa.array(h, long), pa.array(at, long), pa.array([kind] * len(ids), pa.int32()), pa.array(before, texts), pa.array(after, texts)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "t", "n_words", "h", "at", "size", "before", "after"])


def _bit_table(prints: DataFrame) -> bytes:
    """Which of ``BITS`` low ends of hashes occur, as bits: 512 rows of 4 KB at most reach the driver."""
    bit = (F.col("h").bitwiseAND(BITS - 1) + 1).alias("bit")
    blocks = prints.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = bytearray(BITS // 8)
    for row in blocks.collect():
        table[(row.block - 1) * (_BLOCK // 8) : row.block * (_BLOCK // 8)] = bytes(row.bits)
    return bytes(table)


def _shared_start(a: Column, b: Column) -> Column:
    """How many items two arrays have in common from their start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    miss = F.array_position(same, F.lit(False))
    return F.when(miss > 0, miss - 1).otherwise(F.size(same)).cast("int")


def words_text(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, joined by spaces; null counts as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_join(F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != ""), " ")


def shared_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What documents share with benchmark items: (texts, hits, classes).

    ``texts(id, t, n_words)`` has a row for each document, ``hits(id, t, at, start, end, class)`` the runs of words
    [start, end) that stand in items too, with the items' class; ``classes(class, item_id)`` lists the items of a class
    (items of equal words). ``t`` tells texts of one id apart.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = items.select(F.col(item_col).cast("string").alias("item_id"), words_text(F.col(item_text_col)).alias("words")).where("item_id IS NOT NULL AND words <> ''")
    named = materialise(named.select(F.md5("words").alias("class"), "item_id", "words").distinct(), "leak-items")
    contents = named.select("class", "words").distinct()
    counts = contents.select(F.size(F.split("words", " ")).alias("n")).where(F.col("n") < window).distinct().collect()  # fewer than ``window`` rows
    shorter = sorted(r.n for r in counts)
    asked = contents.select("class", F.lit(0).cast("long").alias("t"), "words").mapInArrow(_fingerprints(window, gram, shorter, True), f"id string, {_FOUND}")
    prints = materialise(asked.where("h IS NOT NULL").select(F.col("id").alias("class"), "h", "size", F.col("before").alias("item_before"), F.col("after").alias("item_after")), "leak-prints")
    table = spark.sparkContext.broadcast(_bit_table(prints))
    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(text_col))
    seen = materialise(whole.mapInArrow(_fingerprints(window, gram, shorter, False, table), f"id long, {_FOUND}"), "leak-seen")
    met = seen.where("h IS NOT NULL").join(prints, ["h", "size"])
    met = met.select("id", "t", "at", "size", "class", _shared_start(F.col("before"), F.col("item_before")).alias("left"), _shared_start(F.col("after"), F.col("item_after")).alias("right"))
    long_enough = F.when(F.col("size") == 0, (F.col("right") >= gram) & (F.col("left") + F.col("right") >= window)).otherwise(F.col("right") >= F.col("size"))
    hits = met.where(long_enough).select("id", "t", "at", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end"), "class")
    return seen.where("h IS NULL").select("id", "t", "n_words"), hits, named.select("class", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated, spans) for every document.

    Words are lower-cased runs of a-z, 0-9 and code points from 128. A word is hit where it stands in ``window``
    consecutive words that an item has too, or in all words of an item that has fewer. ``items`` are the ids of these
    items, sorted as texts; ``spans`` the maximal runs [start, end) of words hit. Null and empty texts and items have no
    words. Documents and items with a null id are left out; a document row that comes again comes out again; an item id
    with several texts stands for all of them. Empty tables are no special case, other columns are ignored.
    """
    texts, hits, classes = shared_passages(docs, items, id_col, text_col, item_col, item_text_col, window, gram)
    # all runs around one place hold it: their union is a run
    places = hits.groupBy("id", "t", "at").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("class").alias("classes"))
    by_text = places.groupBy("id", "t").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"))
    last = lambda spans: F.element_at(spans, -1)

    def join(spans: Column, run: Column) -> Column:
        grown = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last(spans)["start"].alias("start"), F.greatest(last(spans)["end"], run["end"]).alias("end"))))
        return F.when((F.size(spans) > 0) & (F.get(spans, F.size(spans) - 1)["end"] >= run["start"]), grown).otherwise(F.concat(spans, F.array(run)))

    spans = F.aggregate("runs", F.array().cast("array<struct<start:bigint,end:bigint>>"), join)
    by_text = materialise(by_text.select("id", "t", spans.alias("spans"), "classes"), "leak-texts")
    # documents with the same classes share one list of items
    lists = by_text.select("classes").distinct().select("classes", F.explode("classes").alias("class")).join(classes, "class").groupBy("classes").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = by_text.join(lists, "classes").drop("classes")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    out = texts.join(found, ["id", "t"], "left").select(F.col("id").alias("doc_id"), "n_words", none("spans", "array<struct<start:bigint,end:bigint>>").alias("spans"), none("items", "array<string>").alias("items"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("spans") > 0).alias("contaminated"), "spans")
