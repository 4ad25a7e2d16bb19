"""Suffix-array dedup: removes every byte covered by a string of a given length that also starts elsewhere.

Fragments that share an anchor (see ``repeats``) are dealt out to tasks, and each task sorts the suffixes of its
fragments by the difference-cover algorithm: triples at places 1 and 2 modulo 3 are sorted and named, the names are
sorted by recursion, the other suffixes are merged in, and the prefixes of neighbours are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, Rolling, slices, utf8
from .repeats import groups_of, merge_starts, repeated_spans, spans_batch, union_spans


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of positive integers, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.uint64)
    t[:n] = text
    top = int(t.max()) + 1
    # the sample holds one place past the end where n % 3 == 1, so that places 1 and 2 stay apart in the recursion
    one = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate([one, np.arange(2, n, 3)])
    if top < 1 << 21:
        key = (t[sample] * np.uint64(top) + t[sample + 1]) * np.uint64(top) + t[sample + 2]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        s = sample[order]
        new = np.append(True, (t[s[1:]] != t[s[:-1]]) | (t[s[1:] + 1] != t[s[:-1] + 1]) | (t[s[1:] + 2] != t[s[:-1] + 2]))
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if names.max() < len(sample):
        order = suffix_order(names)
    rank = np.zeros(n + 4, np.uint64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    chosen = sample[order]
    chosen = chosen[chosen < n]
    zero = np.arange(0, n, 3)
    big = np.uint64(len(sample) + 2)
    by_one = t[:n] * big + rank[1 : n + 1]  # compares with places 1: symbol, then a sampled suffix
    zero = zero[np.argsort(by_one[zero], kind="stable")]
    ones, twos = chosen[chosen % 3 == 1], chosen[chosen % 3 == 2]
    if top < 1 << 20 and int(big) < 1 << 23:
        wide = np.uint64(top)
        two_key = lambda p: (t[p] * wide + t[p + 1]) * big + rank[p + 2]
        less = np.searchsorted(by_one[ones], by_one[zero]) + np.searchsorted(two_key(twos), two_key(zero))
    else:
        pair = t[:n] * np.uint64(top) + t[1 : n + 1] if top < 1 << 32 else None
        both = np.concatenate([twos, zero])
        by = np.lexsort((rank[both + 2], pair[both])) if pair is not None else np.lexsort((rank[both + 2], t[both + 1], t[both]))
        is_two = by < len(twos)
        less_two = np.empty(len(both), np.int64)
        less_two[by] = np.cumsum(is_two)
        less = np.searchsorted(by_one[ones], by_one[zero]) + less_two[len(twos) :]
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    place = less + np.arange(len(zero))
    out[place] = zero
    taken[place] = True
    out[~taken] = chosen
    return out


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Starts of strings of ``length`` non-zero symbols that stand at two places or more of ``text``, sorted."""
    order = suffix_order(text.astype(np.int64) + 1)
    n = len(text)
    order = order[order + length <= n]
    if len(order) < 2:
        return order[:0]
    # a cheap look at both ends first, then the whole prefixes of neighbours
    a, b = order[:-1], order[1:]
    ok = (text[a] == text[b]) & (text[a + length - 1] == text[b + length - 1]) & (text[a + length // 2] == text[b + length // 2])
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    at = np.flatnonzero(ok)
    for lo in range(0, len(at), 4096):
        x = at[lo : lo + 4096]
        va = view[a[x]]
        ok[x] = ((va == view[b[x]]) & (va != 0)).all(1)
    return np.unique(np.concatenate([a[ok], b[ok]]))


def _decide(length: int):
    def run(batches):
        for groups in groups_of(batches):
            rows = [r for g in groups for r in g]
            size = np.array([len(r[7]) + 1 for r in rows])
            at = np.cumsum(size) - size
            # separators are the smallest symbol; bytes count from 1
            text = np.zeros(int(size.sum()), np.int16)
            for r, a in zip(rows, at, strict=True):
                text[a : a + len(r[7])] = np.frombuffer(r[7], np.uint8)
                text[a : a + len(r[7])] += 1
            starts = repeated_starts(text, length)
            lo, hi = np.searchsorted(starts, at), np.searchsorted(starts, at + size)
            out = []
            for r, a, x, y in zip(rows, at, lo, hi, strict=True):
                if r[6] > 1:  # this content stands at several places
                    b, e = [0], [len(r[7])]
                elif x < y:
                    b, e = (v.tolist() for v in merge_starts(starts[x:y] - a, length))
                else:
                    continue
                out.append((r[0], r[1], b, e))
            if out:
                yield spans_batch(out)

    return run


def _tokenise(buf: np.ndarray, bounds: np.ndarray, rolling: Rolling):
    return BYTE_VALUE[buf], bounds


def _locate(text: np.ndarray):
    return None, None


def _remove(batches):
    for batch in batches:
        ids, spans = batch.column(0), batch.column(2).to_pylist()
        buf, off = utf8(batch.column(1))
        n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
        for k, found in enumerate(spans):
            text = buf[off[k] : off[k + 1]].tobytes()
            runs = union_spans(found, len(text))
            if runs:
                at, parts = 0, []
                for b, e in runs:
                    parts.append(text[at:b])
                    at = e
                left = b"".join([*parts, text[at:]])
            else:
                left = text
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(left))
            n_spans.append(len(runs))
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, k: int = 16) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string that also starts anywhere else, in the same text or another.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every document: sizes before and of what is
    removed, the number of maximal removed runs, and the remaining bytes with their SHA-256. Texts are judged as they
    came in, as UTF-8 bytes; matches never cross documents, overlaps within one count. Null texts are empty; texts
    shorter than ``length`` stay whole. Rows with a null id are left out; ids are taken as distinct. A copy of a text
    of ``length`` bytes or more loses everything, as does the text itself. Other columns are ignored.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(base, _tokenise, _locate, _decide(length), length, k, 4096, False, "suffixes")
    joined = base.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
