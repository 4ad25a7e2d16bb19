"""Substring dedup: removes passages of documents that also stand in a document with a smaller id.

Fragments of documents that share an anchor (see ``repeats``) are reference shards of bounded size. Each shard's
suffix automaton meets the fragments of its anchor: these stream through it for their matching statistics, and the
maximal spans of windows that an earlier document holds are removed. Sending every shard to every task would cost
the square of the corpus; a window can only be found where its anchor is, so each shard goes to its anchor's task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Rolling, utf8, words_of
from .repeats import groups_of, merge_starts, repeated_spans, spans_batch, union_spans



class SuffixAutomaton:
    """The substrings of several word sequences, each state with the smallest owner of its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.owner = [-1], [0], [1 << 63]

    def add(self, words: list, owner: int) -> None:
        nxt, link, size, own = self.next, self.link, self.size, self.owner
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and size[q] == size[last] + 1:
                last = q
            else:
                state = -1
                p = last
                if q is None:
                    state = len(nxt)
                    nxt.append({})
                    link.append(0)
                    size.append(size[last] + 1)
                    own.append(1 << 63)
                    while p >= 0 and w not in nxt[p]:
                        nxt[p][w] = state
                        p = link[p]
                    if p >= 0:
                        q = nxt[p][w]
                if p >= 0 and q is not None:
                    if size[q] == size[p] + 1:
                        target = q
                    else:
                        target = len(nxt)
                        nxt.append(dict(nxt[q]))
                        link.append(link[q])
                        size.append(size[p] + 1)
                        own.append(own[q])
                        link[q] = target
                        while p >= 0 and nxt[p].get(w) == q:
                            nxt[p][w] = target
                            p = link[p]
                    if state >= 0:
                        link[state] = target
                    else:
                        state = target
                last = state
            if owner < own[last]:
                own[last] = owner

    def close(self) -> None:
        """Owners of longer strings own their suffixes too."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[s]
            if self.owner[s] < self.owner[p]:
                self.owner[p] = self.owner[s]

    def owned_before(self, words: list, owner: int, length: int) -> list[int]:
        """Starts of the windows of ``length`` words that a smaller owner holds."""
        nxt, link, size, own = self.next, self.link, self.size, self.owner
        state = matched = 0
        out = []
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = size[state]
                to = nxt[state].get(w)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= length:
                while size[link[state]] >= length:
                    state = link[state]
                matched = length
                if own[state] < owner:
                    out.append(i - length + 1)
        return out


def _decide(length: int):
    def run(batches):
        for groups in groups_of(batches):
            out = []
            for group in groups:
                if len(group) < 2:
                    continue
                lo, hi = group[0][2], group[0][3]
                texts = [r[7].split() for r in group]
                shard = SuffixAutomaton()
                for r, words in zip(group, texts, strict=True):
                    if r[4] == lo:
                        shard.add(words, r[5])
                shard.close()
                for r, words in zip(group, texts, strict=True):
                    if r[4] == hi:
                        starts = shard.owned_before(words, r[5], length)
                        if starts:
                            b, e = merge_starts(np.array(starts), length)
                            out.append((r[0], r[1], b.tolist(), e.tolist()))
            if out:
                yield spans_batch(out)

    return run


def _tokenise(buf: np.ndarray, bounds: np.ndarray, rolling: Rolling):
    _, _, hashes, first = words_of(buf, bounds, rolling, lower=False)
    return hashes, first


def _locate(text: np.ndarray):
    begin, end, _, _ = words_of(text, np.array([0, len(text)]), Rolling(), lower=False)
    return begin, end


def _remove(batches):
    for batch in batches:
        ids, spans, others = batch.column(0), batch.column(2).to_pylist(), batch.columns[3:]
        buf, off = utf8(batch.column(1))
        n_words, n_removed, digests, kept = [], [], [], []
        for k, found in enumerate(spans):
            text = buf[off[k] : off[k + 1]].tobytes()
            words = text.split()
            n = len(words)
            if gone := union_spans(found, n):
                begin, end = _locate(np.frombuffer(text, np.uint8))
                at, parts = 0, []
                for b, e in gone:
                    parts.append(text[at : begin[b]])
                    at = int(end[e - 1])
                text = b"".join([*parts, text[at:]])
                for b, e in reversed(gone):
                    del words[b:e]
            n_words.append(n)
            n_removed.append(n - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            kept.append(text)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), *others], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *batch.schema.names[3:]])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 8, others: tuple[str, ...] = ()) -> DataFrame:
    """Removes each word covered by a window of ``length`` words that also starts in a document with a smaller id.

    Returns (doc_id, n_words, n_removed, kept_sha256, kept) and the columns named in ``others`` for every row; ``kept`` is the text without the removed
    words, white space as it was, and the digest is of the kept words joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows lie within one document and are judged as the texts
    came in. Null texts have no words; texts shorter than ``length`` words keep all. A passage repeated within its
    first document stays there. Rows with a null id are left out; rows that repeat an id with its text get the same
    result, one id with several texts is not provided for. Other columns are ignored.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(base, _tokenise, _locate, _decide(length), length, k, 1024, True, "passages")
    carried = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0), *others).alias("others"))
    joined = carried.join(spans, "doc_id", "left").select("doc_id", "text", "spans", *(F.col(f"others.{c}") for c in others))
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return joined.mapInArrow(_remove, StructType(schema.fields + joined.schema.fields[3:]))
