"""N-gram Jaccard join: links documents whose sets of word n-grams have a Jaccard similarity of a threshold or more.

Plan: (1) one scan counts hashed n-grams over all documents into a table of fixed size; (2) a second scan orders
each document's n-grams rare-first by these counts, takes the prefix that any similar document must share, and
deals (n-gram, document, size, position) out by n-gram; (3) each n-gram's list gives candidate pairs under the length
and positional filters; (4) candidates meet both texts once, where a suffix filter and the exact sets decide.
Long lists do not give all their pairs: in two rounds every member meets one pivot for each list, what these links
connect is joined to groups, and only pairs of different groups remain to be compared. No link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buckets, Rolling, blob_schema, connected_components, materialise, mix64, partitions, runs_of, slices, unblob, utf8, words_of

_POST = np.dtype([("h", "<u8"), ("d", "<i8"), ("n", "<u4"), ("p", "<u4")])
_MULT = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)]
#: Cells of the n-gram count table, whatever the input: 4 MB to each executor.
COUNT_CELLS = 1 << 20
#: Lists up to this length give all their pairs at once.
SHORT_LIST = 8
PIVOT_ROUNDS = 2


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int, rolling: Rolling) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: ``size`` words, or all words of a shorter text."""
    _, _, words, first = words_of(buf, offsets, rolling, lower=True)
    grams = np.zeros(0, np.uint64)
    if len(words) >= size:
        grams = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            grams += words[k : len(words) - size + 1 + k] * _MULT[k % 8] + np.uint64(k)
        grams = mix64(grams)
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= size:
            g = np.sort(grams[a : b - size + 1])
            yield g[np.append(True, g[1:] != g[:-1])] if len(g) > 1 else g
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = mix64(h * _MULT[1] + words[k : k + 1])
            yield h
        else:
            yield grams[:0]


def _set_key(g: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(np.sum(mix64(g), dtype=np.uint64).view(np.int64)), int(np.sum(mix64(g ^ _MULT[2]), dtype=np.uint64).view(np.int64))


def _sets(batches, id_at: int, text_at: int, size: int):
    rolling = Rolling()
    for batch in batches:
        ids = batch.column(id_at).to_numpy(zero_copy_only=False)
        buf, off = utf8(batch.column(text_at))
        for lo, hi in slices(off):
            for i, g in enumerate(shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size, rolling)):
                yield int(ids[lo + i]), g


def _count(size: int, cells: int, block: int):
    def run(batches):
        from pyspark import TaskContext

        counts, seen, rows, held, total = np.zeros(cells, np.int64), set(), [], [], 0
        for doc, g in _sets(batches, 0, 1, size):
            key = _set_key(g)
            rows.append((doc, len(g), *key))
            if len(g) and key not in seen:
                seen.add(key)
                held.append(g)
                total += len(g)
            if total > 1 << 18:
                counts += np.bincount((np.concatenate(held) % np.uint64(cells)).astype(np.int64), minlength=cells)
                held, total = [], 0
            if len(rows) >= 20_000:
                yield _key_rows(rows)
                rows = []
        if held:
            counts += np.bincount((np.concatenate(held) % np.uint64(cells)).astype(np.int64), minlength=cells)
        if rows:
            yield _key_rows(rows)
        if counts.any():
            part = TaskContext.get().partitionId()
            n = cells // block
            blobs = [counts[k * block : (k + 1) * block].astype("<u4").tobytes() for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.nulls(n, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n", "k1", "k2", "blob"])

    return run


def _key_rows(rows) -> pa.RecordBatch:
    a = np.array(rows, dtype=np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(a[:, k]) for k in range(4)), pa.nulls(len(a), pa.binary())], names=["doc_id", "n", "k1", "k2", "blob"])


def _add_up(batches):
    sums: dict[tuple, np.ndarray] = {}
    for b in batches:
        for k, g, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            v = np.frombuffer(blob.as_buffer(), "<u4").astype(np.int64)
            sums[k, g] = sums[k, g] + v if (k, g) in sums else v
    for (k, g), v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([g], pa.int64()), pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["k1", "g", "blob"])


def _count_table(counted: DataFrame, cells: int, block: int) -> np.ndarray:
    """The summed count table: a fixed number of cells, in two steps so that no task adds up every partition's."""
    n = cells // block
    blobs = counted.where("blob IS NOT NULL").select("k1", F.pmod("n", F.lit(16)).alias("g"), "blob")
    for _ in range(2):
        blobs = blobs.repartition(n, "k1", "g").mapInArrow(_add_up, "k1 long, g long, blob binary").withColumn("g", F.lit(0).cast("long"))
    table = np.zeros(cells, np.int64)
    for row in blobs.collect():
        table[row.k1 * block : (row.k1 + 1) * block] += np.frombuffer(row.blob, "<u4")
    return np.minimum(table, 2**32 - 1).astype(np.uint32)


def _prefixes(size: int, num: int, den: int, cells: int, buckets: int, table):
    def run(batches):
        counts, seen, out = table.value, set(), Buckets(_POST, buckets, 1 << 19)
        for doc, g in _sets(batches, 0, 1, size):
            n = len(g)
            if not n:
                continue
            key = _set_key(g)
            if key in seen:
                continue
            seen.add(key)
            order = np.lexsort((g, counts[(g % np.uint64(cells)).astype(np.int64)]))
            length = n - -(-num * n // den) + 1
            rec = np.empty(length, _POST)
            rec["h"], rec["d"], rec["n"], rec["p"] = g[order[:length]], doc, n, np.arange(length)
            yield from out.add((rec["h"] >> np.uint64(40)).astype(np.int64) % buckets, rec)
        yield from out.flush()

    return run


def _passes(n1, p1, n2, p2, num: int, den: int) -> np.ndarray:
    """Length and positional filters, for one shared n-gram at these places of both orders."""
    n1, p1, n2, p2 = (x.astype(np.int64) for x in (n1, p1, n2, p2))
    need = -(-num * (n1 + n2) // (num + den))
    return (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num) & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= need)


_OUT = "a long, b long, h long, n long, p long"


def _out(a, b, h=None, n=None, p=None) -> pa.RecordBatch:
    cols = [pa.array(np.asarray(a, np.int64))] + [pa.nulls(len(a), pa.int64()) if x is None else pa.array(np.asarray(x, np.int64)) for x in (b, h, n, p)]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "h", "n", "p"])


def _pairs_out(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    a, b = np.minimum(d[i], d[j]), np.maximum(d[i], d[j])
    pair = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    return _out(pair[:, 0], pair[:, 1])


def _lists(num: int, den: int, short: int):
    """Per task: all pairs of short lists, pivot pairs of long ones, and the long lists themselves."""

    def run(batches):
        rec = unblob(batches, _POST)
        rec = rec[np.lexsort((rec["d"], rec["n"], rec["h"]))]
        start, length = runs_of(rec["h"])
        found: list[np.ndarray] = []
        for m in range(2, short + 1):
            at = start[length == m]
            for x in range(m):
                for y in range(x + 1, m):
                    i, j = at + x, at + y
                    ok = _passes(rec["n"][i], rec["p"][i], rec["n"][j], rec["p"][j], num, den)
                    found.append(np.stack([i[ok], j[ok]]))
        keep = np.repeat(length > short, length)
        if keep.any():
            long = rec[keep]
            yield _out(long["d"], None, long["h"].view(np.int64), long["n"], long["p"])
        if found:
            i, j = np.concatenate(found, 1)
            if len(i):
                yield _pairs_out(i, j, rec["d"])

    return run


def _rounds(num: int, den: int, salt: int | None):
    """Pairs of different groups within long lists (rows: h, d, n, p, group).

    With a salt, one member of each list is its pivot and meets every member of other groups; without one, all pairs
    of different groups are given, in blocks of rows.
    """

    def run(batches):
        cols = [np.concatenate(x) for x in zip(*([c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows), strict=True)] if (batches := list(batches)) and any(b.num_rows for b in batches) else None
        if cols is None:
            return
        h, d, n, p, g = cols
        order = np.lexsort((d, g, h))
        h, d, n, p, g = (x[order] for x in (h, d, n, p, g))
        start, length = runs_of(h)
        for a, m in zip(start.tolist(), length.tolist(), strict=True):
            s = slice(a, a + m)
            if g[a] == g[a + m - 1]:
                continue
            if salt is not None:
                # the largest group is the one to grow: its members serve as pivots, a different one for each list
                first, size = runs_of(g[s])
                big = int(np.argmax(size))
                pick = mix64((d[s].astype(np.uint64) + np.uint64(salt)) * _MULT[3] ^ h[a : a + 1].astype(np.uint64))
                members = np.arange(first[big], first[big] + size[big])
                piv = a + int(members[np.argmin(pick[members])])
                other = a + np.flatnonzero(g[s] != g[piv])
                ok = _passes(n[other], p[other], np.full(len(other), n[piv]), np.full(len(other), p[piv]), num, den)
                other = other[ok]
                if len(other):
                    yield _pairs_out(other, np.full(len(other), piv), d)
            else:
                for i in range(a, a + m - 1):
                    j = np.arange(max(i + 1, a + int(np.searchsorted(g[s], g[i], side="right"))), a + m)
                    if len(j):
                        ok = _passes(n[j], p[j], np.full(len(j), n[i]), np.full(len(j), p[i]), num, den)
                        if ok.any():
                            yield _pairs_out(j[ok], np.full(int(ok.sum()), i), d)

    return run


def _verify(size: int, num: int, den: int):
    cuts = np.linspace(0, 2**64 - 1, 17)[1:-1].astype(np.uint64)

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ba, oa = utf8(batch.column(2))
            bb, ob = utf8(batch.column(3))
            keep = np.zeros(len(a), bool)
            for lo, hi in slices(oa + ob):
                left = shingle_sets(ba[oa[lo] : oa[hi]], oa[lo : hi + 1] - oa[lo], size, rolling)
                right = shingle_sets(bb[ob[lo] : ob[hi]], ob[lo : hi + 1] - ob[lo], size, rolling)
                for k, (x, y) in enumerate(zip(left, right, strict=True)):
                    both = len(x) + len(y)
                    # suffix filter: sizes of the parts between fixed cuts bound the symmetric difference from below
                    px, py = np.searchsorted(x, cuts), np.searchsorted(y, cuts)
                    differ = int(np.abs(np.diff(px, prepend=0, append=len(x)) - np.diff(py, prepend=0, append=len(y))).sum())
                    if (num + den) * (both - differ) < 2 * num * both:
                        continue
                    z = np.sort(np.concatenate([x, y]))
                    same = int((z[1:] == z[:-1]).sum())
                    keep[lo + k] = bool(both) and den * same >= num * (both - same)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, numerator: int = 80, denominator: int = 100, cells: int = COUNT_CELLS) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``numerator / denominator`` or more of their word n-grams.

    Returns (doc_id, n_shingles, component_id): the size of the set and the smallest id reachable by links.
    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; n-grams are compared by 64-bit hashes. A text with fewer
    words than ``size`` counts as one n-gram; null and empty texts have none and link with nothing. Equal sets share a
    group whatever their number. Rows with a null id are left out; ids are taken as distinct. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_part, block = partitions(spark), min(cells, 1 << 16)
    counted = materialise(base.mapInArrow(_count(size, cells, block), "doc_id long, n long, k1 long, k2 long, blob binary"), "ngram-sets")
    table = spark.sparkContext.broadcast(_count_table(counted, cells, block))
    keys = counted.where("doc_id IS NOT NULL").select("doc_id", "n", "k1", "k2")
    buckets = 16 * n_part
    dealt = base.mapInArrow(_prefixes(size, numerator, denominator, cells, buckets, table), blob_schema("bucket"))
    lists = materialise(dealt.repartition(n_part, "bucket").mapInArrow(_lists(numerator, denominator, SHORT_LIST), _OUT), "ngram-lists")
    todo = materialise(lists.where("b IS NOT NULL").select("a", "b").distinct(), "ngram-pairs")
    long = lists.where("b IS NULL").select("h", F.col("a").alias("d"), "n", "p")
    members = todo.select(F.col("a").alias("doc_id")).unionAll(todo.select("b")).unionAll(long.select("d")).distinct()
    texts = materialise(base.join(members, "doc_id", "left_semi"), "ngram-texts")
    classes = materialise(keys.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "ngram-classes")
    # a document that stood for its set in some partition links to the set's smallest id
    same = materialise(keys.where("n > 0").join(classes, ["k1", "k2"]).select("doc_id", "n", "rep"), "ngram-same")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        return materialise(met.mapInArrow(_verify(size, numerator, denominator), "a long, b long"), "ngram-links")

    equal = same.join(members, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    links = verified(todo).unionAll(equal)
    if not long.isEmpty():
        done = todo
        for step in (*range(PIVOT_ROUNDS), None):
            groups = connected_components(links, "ngram-groups").select(F.col("id").alias("d"), F.col("component").alias("g"))
            grouped = long.join(groups, "d", "left").select("h", "d", "n", "p", F.coalesce("g", "d").alias("g"))
            more = grouped.repartition(n_part, "h").mapInArrow(_rounds(numerator, denominator, step), _OUT).select("a", "b").distinct()
            more = materialise(more.join(done, ["a", "b"], "left_anti"), "ngram-pairs")
            links = links.unionAll(verified(more))
            done = done.unionAll(more)
    groups = connected_components(links, "ngram-groups")
    # every document of a set has the group of the set's smallest id
    reps = classes.select(F.col("rep").alias("id")).join(groups, "id").select(F.col("id").alias("rep"), "component")
    reps = materialise(reps, "ngram-reps")
    out = same.join(reps, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.unionAll(keys.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
