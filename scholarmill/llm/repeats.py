"""Finding where token windows of a fixed length repeat, by shared anchors.

A window's anchor is the smallest hash among its k-grams, so equal windows have equal anchors wherever they stand.
Neighbouring windows with one anchor form a fragment. Fragments are dealt out by anchor; an anchor with one
fragment only cannot hold a repeat. What remains (fragments that share an anchor) is small, is fetched once per
distinct content, and goes to the operator that decides: a suffix array or a suffix automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buckets, Rolling, blob_schema, materialise, mix64, partitions, runs_of, slices, unblob, utf8

FRAGMENT = np.dtype([("h", "<u8"), ("c", "<u8"), ("d", "<i8"), ("s", "<u4"), ("m", "<u4")])
_TWICE = np.uint32(1 << 31)  # the anchor's k-gram stands in the fragment more than once
_WHOLE = np.uint32((1 << 31) - 1)  # not a fragment: the whole text repeats an earlier one of its partition


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for each i, by running results from both ends of blocks of w."""
    n = len(x) - w + 1
    fill = -len(x) % w
    blocks = np.append(x, np.full(fill, x[-1], x.dtype)).reshape(-1, w)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n], left[w - 1 : w - 1 + n])


def fragments(tokens: np.ndarray, first: np.ndarray, length: int, k: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Fragments of several token sequences (``first``: their bounds) and the index of each one's sequence."""
    n = len(tokens)
    empty = np.zeros(0, FRAGMENT), np.zeros(0, np.int64)
    if n < length:
        return empty
    size = np.diff(first)
    has = np.flatnonzero(size >= length)
    if not len(has):
        return empty
    sums = rolling.sums(tokens)
    at = np.arange(n - k + 1)
    grams = mix64(rolling.of(sums, at, at + k)) | np.uint64(1)
    w = length - k + 1
    least = _sliding(grams, w, np.minimum)
    valid = np.zeros(n - length + 2, np.int32)
    np.add.at(valid, first[has], 1)
    np.add.at(valid, first[has + 1] - length + 1, -1)
    least[np.cumsum(valid[:-1]) == 0] = 0
    start, count = runs_of(least)
    on = least[start] > 0
    start, count = start[on], count[on]
    value, last = least[start], start + count - 1
    # places of k-grams that are some window's anchor
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    places = np.flatnonzero(grams == _sliding(padded, w, np.maximum)[: len(grams)])
    distinct, rank = np.unique(grams[places], return_inverse=True)
    key = np.sort(rank.astype(np.int64) * n + places)
    own = np.searchsorted(distinct, value).astype(np.int64) * n
    second = np.searchsorted(key, own + start) + 1
    twice = (second < len(key)) & (key[np.minimum(second, len(key) - 1)] <= own + last + length - k)
    seq = np.searchsorted(first, start, side="right") - 1
    out = np.empty(len(start), FRAGMENT)
    out["h"], out["c"] = value, mix64(rolling.of(sums, start, last + length) + (last - start).astype(np.uint64))
    out["s"], out["m"] = start - first[seq], last + length - start
    out["m"][twice] |= _TWICE
    return out, seq


def _deal(tokenise: Callable, length: int, k: int, buckets: int, earlier_only: bool):
    """Deals fragments out by anchor. Copies of a text within the partition are settled here."""

    def run(batches):
        rolling, out = Rolling(), Buckets(FRAGMENT, buckets, 1 << 19)
        seen: dict[bytes, list] = {}

        def whole(doc: int):
            rec = np.zeros(1, FRAGMENT)
            rec["d"], rec["m"] = doc, _WHOLE
            return out.add(np.array([doc % buckets]), rec)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = utf8(batch.column(1))
            for lo, hi in slices(off):
                part, bounds = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                tokens, first = tokenise(part, bounds, rolling)
                recs, seq = fragments(tokens, first, length, k, rolling)
                skip = np.zeros(hi - lo, bool)
                for i in np.flatnonzero(np.diff(first) >= length):
                    doc, key = int(ids[lo + i]), hashlib.blake2b(part[bounds[i] : bounds[i + 1]], digest_size=16).digest()
                    known = seen.get(key)
                    if known is None:
                        seen[key] = [doc, False]
                        continue
                    if earlier_only:
                        later = max(doc, known[0])
                        skip[i] = doc >= known[0]
                        if doc != known[0]:  # a row again is no earlier document
                            yield from whole(later)
                        known[0] = min(doc, known[0])
                    else:
                        skip[i] = True
                        yield from whole(doc)
                        if not known[1]:
                            known[1] = True
                            yield from whole(known[0])
                recs["d"] = ids[lo + seq]
                recs = recs[~skip[seq]]
                yield from out.add((recs["h"] >> np.uint64(40)).astype(np.int64) % buckets, recs)
        yield from out.flush()

    return run


FOUND = "kind int, h long, c long, d long, s long, m long, first long, copies long, i int, parts int"


def _find(chunk: int):
    """Fragments that share an anchor (kind 1: every place; kind 2: one for each content) and whole copies (kind 0)."""

    def run(batches):
        rec = unblob(batches, FRAGMENT)
        if not len(rec):
            return
        whole = rec[rec["m"] == _WHOLE]
        if len(whole):
            yield _found(0, whole)
        rec = rec[rec["m"] != _WHOLE]
        twice = (rec["m"] & _TWICE) > 0
        rec["m"] &= ~_TWICE
        order = np.lexsort((rec["s"], rec["d"], rec["c"], rec["h"]))
        rec, twice = rec[order], twice[order]
        start, count = runs_of(rec["h"])
        on = (count > 1) | twice[start]
        keep = np.repeat(on, count)
        rec, twice = rec[keep], twice[keep]
        if not len(rec):
            return
        new = np.append(True, (rec["h"][1:] != rec["h"][:-1]) | (rec["c"][1:] != rec["c"][:-1]))
        start = np.flatnonzero(new)
        copies = np.diff(np.append(start, len(rec)))
        for a in range(0, len(rec), 1 << 18):
            yield _found(1, rec[a : a + (1 << 18)])
        head, within = rec[start], np.logical_or.reduceat(twice, start)
        # contents of one anchor by their smallest id, in parts of bounded size
        order = np.lexsort((head["d"], head["h"]))
        head, copies, within = head[order], copies[order], within[order]
        at, n = runs_of(head["h"])
        rank = np.arange(len(head)) - np.repeat(at, n)
        # a content alone with its anchor, which it holds once, has nothing to be compared with: its copies decide
        parts = np.where((np.repeat(n, n) == 1) & ~within, 0, np.repeat(-(-n // chunk), n))
        yield _found(2, head, head["d"], copies, rank // chunk, parts)

    return run


def _found(kind: int, r: np.ndarray, first=None, copies=None, i=None, parts=None) -> pa.RecordBatch:
    n = len(r)
    cols = [pa.array(np.full(n, kind, np.int32)), pa.array(r["h"].view(np.int64) if r["h"].flags.c_contiguous else np.ascontiguousarray(r["h"]).view(np.int64)), pa.array(np.ascontiguousarray(r["c"]).view(np.int64)), pa.array(r["d"].astype(np.int64)), pa.array(r["s"].astype(np.int64)), pa.array(r["m"].astype(np.int64))]
    cols += [pa.nulls(n, t) if x is None else pa.array(np.asarray(x).astype(t.to_pandas_dtype())) for x, t in ((first, pa.int64()), (copies, pa.int64()), (i, pa.int32()), (parts, pa.int32()))]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "h", "c", "d", "s", "m", "first", "copies", "i", "parts"])


def _cut(locate: Callable):
    """Cuts the wanted fragments (rows: text, wanted list) out of their texts, once for each pair of parts they go to."""

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(0))
            wanted = batch.column(1).to_pylist()
            out: list[tuple] = []
            held = 0
            for k, want in enumerate(wanted):
                text = buf[off[k] : off[k + 1]]
                begin, end = locate(text)
                for w in want:
                    a, b = w["s"], w["s"] + w["m"]
                    piece = text[(a if begin is None else begin[a]) : (b if end is None else end[b - 1])].tobytes()
                    for j in range(w["parts"]):
                        lo, hi = min(w["i"], j), max(w["i"], j)
                        out.append((w["h"], w["c"], lo, hi, w["i"], w["first"], w["copies"], piece))
                        held += len(piece) + 64
                    if held > 8 << 20:
                        yield _pieces(out)
                        out, held = [], 0
            if out:
                yield _pieces(out)

    return run


PIECE = "h long, c long, lo int, hi int, i int, first long, copies long, piece binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=["h", "c", "lo", "hi", "i", "first", "copies", "piece"])


def groups_of(batches: Iterator[pa.RecordBatch], hold: int = 1 << 20) -> Iterator[list[list[tuple]]]:
    """Rows of a partition sorted by (h, lo, hi): whole groups, gathered to about ``hold`` bytes.

    Groups of one anchor share contents, so they never come together.
    """
    ready: list[list[tuple]] = []
    group: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[-1][0:1] + group[-1][2:4] != row[0:1] + row[2:4]:
                ready.append(group)
                same = group[-1][0] == row[0]
                group = []
                if size > hold or same:
                    yield ready
                    ready, size = [], 0
            group.append(row)
            size += len(row[7])
    if group:
        ready.append(group)
    if ready:
        yield ready


SPANS = "h long, c long, begin array<int>, end array<int>"


def spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    h, c, b, e = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(b, pa.list_(pa.int32())), pa.array(e, pa.list_(pa.int32()))], names=["h", "c", "begin", "end"])


def merge_starts(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of [s, s + length) over sorted starts, as maximal spans."""
    if not len(starts):
        return starts, starts
    new = np.append(True, starts[1:] > starts[:-1] + length)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], starts[last] + length


def repeated_spans(docs: DataFrame, tokenise: Callable, locate: Callable, decide: Callable, length: int, k: int, chunk: int, earlier_only: bool, name: str) -> DataFrame:
    """(doc_id, spans array<struct<begin, end>>) in tokens, for the documents (doc_id, text) that have any.

    ``decide`` turns groups of different fragments that share an anchor into the spans of each content whose windows
    repeat; a content that is alone with its anchor repeats as a whole or not at all.
    With ``earlier_only`` a content's spans hold for its smallest id alone; all other places of it are whole repeats.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    dealt = docs.mapInArrow(_deal(tokenise, length, k, 16 * n, earlier_only), blob_schema("bucket"))
    found = materialise(dealt.repartition(n, "bucket").mapInArrow(_find(chunk), FOUND), f"{name}-found")
    want = found.where("kind = 2 AND parts > 0").groupBy(F.col("d").alias("doc_id")).agg(F.collect_list(F.struct("h", "c", "s", "m", "first", "copies", "i", "parts")).alias("want"))
    pieces = docs.join(want, "doc_id").select("text", "want").mapInArrow(_cut(locate), PIECE)
    decided = pieces.repartition(n, "h", "lo", "hi").sortWithinPartitions("h", "lo", "hi").mapInArrow(decide, SPANS)
    if not earlier_only:
        alone = found.where("kind = 2 AND parts = 0 AND copies > 1")
        decided = decided.unionAll(alone.select("h", "c", F.array(F.lit(0)).alias("begin"), F.array(F.col("m").cast("int")).alias("end")))
    decided = materialise(decided, f"{name}-decided")
    if earlier_only:
        first = materialise(found.where("kind = 2").select("h", "c", F.col("d").alias("d"), F.col("s").alias("s0")), f"{name}-first")
        places = found.where("kind = 1").select("h", "c", "d", "s", "m")
        later = places.join(first.select("h", "c", F.col("d").alias("d0")), ["h", "c"]).where("d > d0").select("d", F.col("s").alias("b"), (F.col("s") + F.col("m")).alias("e"))
        # the first document's own places of this content (there may be several)
        own = places.join(first.select("h", "c", "d"), ["h", "c", "d"])
        hit = own.join(decided, ["h", "c"]).select("d", "s", F.explode(F.arrays_zip("begin", "end")).alias("x")).select("d", (F.col("s") + F.col("x.begin")).alias("b"), (F.col("s") + F.col("x.end")).alias("e"))
        spans = later.unionAll(hit)
    else:
        places = found.where("kind = 1").select("h", "c", "d", "s")
        spans = places.join(decided, ["h", "c"]).select("d", "s", F.explode(F.arrays_zip("begin", "end")).alias("x")).select("d", (F.col("s") + F.col("x.begin")).alias("b"), (F.col("s") + F.col("x.end")).alias("e"))
    whole = found.where("kind = 0").select("d", F.lit(0).cast("long").alias("b"), F.lit(2**31 - 1).cast("long").alias("e"))
    return spans.unionAll(whole).groupBy(F.col("d").alias("doc_id")).agg(F.collect_set(F.struct(F.col("b").alias("begin"), F.col("e").alias("end"))).alias("spans"))


def union_spans(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Sorted maximal spans within [0, n); spans that touch are one."""
    out: list[list[int]] = []
    for x in sorted((s["begin"], min(s["end"], n)) for s in spans or ()):
        if x[0] >= x[1]:
            continue
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]
