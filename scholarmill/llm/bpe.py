"""BPE encoding and decoding over whole texts, exact with the tokenizer definition given.

Encoding a word: an Aho-Corasick automaton gives the longest token at every place; tokens are taken left to right,
each checked against its left neighbour by the pair-compatibility rule, falling back to shorter prefixes and earlier
places where a pair could not have come from the merges. Work is linear in the word. Decoding gathers token strings
from one byte table by offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words and pieces remembered by a worker; a full memory starts anew.
REMEMBERED = 300_000
# White space of Unicode, at which the definition's normaliser and splitter part words
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, over all its tasks."""
    module = sys.modules.setdefault("_scholarmill_worker", types.ModuleType("_scholarmill_worker"))
    return module.__dict__


def split_words(text: str) -> list[str]:
    """Words between Unicode white space (``str.split`` also parts at the four separators U+001C to U+001F)."""
    return text.split() if not _ODD.search(text) else [w for w in _SPACES.split(text) if w]


def simpler(word: str) -> tuple[str, ...] | None:
    """Words that together have the same tokens and are met more often; null where the word has none.

    A letter and a closing stop or comma always part. Lower-casing first changes nothing for Latin letters that are
    composed before and after it.
    """
    stem = word.rstrip(".,")
    if stem != word and stem and stem[-1].lower()[-1].isalpha():
        return stem, word[len(stem) :]
    low = word.lower()
    if low != word and "<|" not in word and max(word) < "\u0250" and unicodedata.is_normalized("NFC", low):
        return (low,)
    return None


class Remember(dict):
    """word -> its ids as bytes, encoding what it doesn't know; bounded: what a full memory held is the one before."""

    def __init__(self, encode, most: int = REMEMBERED) -> None:
        self.encode, self.most, self.before = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        found = self.before.get(word)
        if found is None:
            others = simpler(word)
            found = self.encode(word) if others is None else b"".join([self[w] for w in others])
        self[word] = found
        return found


class Gather:
    """Joins table entries by number, with one space between: entries stand in one byte buffer at known offsets."""

    def __init__(self, entries: list[bytes]) -> None:
        self.table = np.frombuffer(b"".join(e + b" " for e in entries), np.uint8)
        self.size = np.array([len(e) + 1 for e in entries], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray) -> bytes:
        out = []
        for lo in range(0, len(ids), 1 << 16):
            part = ids[lo : lo + (1 << 16)]
            size = self.size[part]
            end = np.cumsum(size)
            out.append(self.table[np.repeat(self.at[part] - end + size, size) + np.arange(end[-1])].tobytes())
        return b"".join(out)[:-1]


class Codec:
    """Encoder and decoder for a BPE definition with byte-level symbols and a word-end suffix."""

    def __init__(self, definition: str) -> None:
        import ahocorasick
        import regex

        d = json.loads(definition)
        model, end = d["model"], d["model"].get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.piece_re = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # byte-level symbols: printable bytes stand for themselves, the others follow from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.symbol = {b: 256 + i for i, b in enumerate(rest)}

        def own(token: str) -> str:
            """One character for each symbol; a word's last symbol is another one."""
            return token[: -len(end) - 1] + chr(0xE000 + ord(token[-len(end) - 1])) if end and token.endswith(end) and len(token) > len(end) else token

        n = max([*vocab.values(), *self.special.values()]) + 1
        self.rank, self.parts, self.size = [-1] * n, [None] * n, [0] * n
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.rank[made], self.parts[made], self.merged[vocab[a], vocab[b]] = r, (vocab[a], vocab[b]), made
        strings = {own(t): i for t, i in vocab.items()}
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * n
        for s, i in strings.items():
            self.size[i] = len(s)
            self.automaton.add_word(s, (len(s), i))
            self.shorter[i] = next((strings[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in strings), -1)
        self.automaton.make_automaton()
        self.known_pairs: dict[tuple[int, int], bool] = {}
        names = [b""] * n
        for t, i in [*vocab.items(), *self.special.items()]:
            names[i] = t.encode()
        self.decode = Gather(names)
        self.decimals = Gather([str(i).encode() for i in range(n)])
        self.pieces = Remember(self._piece)
        self.words = Remember(self._word)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between two neighbouring tokens alone.

        Undoes the later of the merges at the border, step by step: the border falls if some merge across it would
        have come before the one undone. Of equal merges the left one comes first.
        """
        key = (left, right)
        found = self.known_pairs.get(key)
        if found is None:
            rank, limit, found = self.rank, 1 << 60, True
            while True:
                across = self.merged.get((left, right))
                if across is not None and rank[across] < limit:
                    found = False
                    break
                if rank[left] < 0 and rank[right] < 0:
                    break
                if rank[left] > rank[right]:
                    limit, left = rank[left], self.parts[left][1]
                else:
                    limit, right = rank[right] + 1, self.parts[right][0]
            if len(self.known_pairs) > 1 << 20:
                self.known_pairs.clear()
            self.known_pairs[key] = found
        return found

    def _piece(self, piece: str) -> bytes:
        text = piece.encode().decode("latin-1").translate(self.symbol)
        text = text[:-1] + chr(0xE000 + ord(text[-1]))
        n = len(text)
        longest = [-1] * (n + 1)
        for end, (k, i) in self.automaton.iter(text):
            longest[end - k + 1] = i  # matches come by their ends: the last one is the longest
        size, shorter, known = self.size, self.shorter, self.known_pairs
        open_at, taken, at, last = [True] * (n + 1), [], 0, -1
        token = longest[0]
        while at < n:
            stop = at + size[token]
            if open_at[stop] and (last < 0 or (known[last, token] if (last, token) in known else self.compatible(last, token))):
                taken.append(token)
                at, last = stop, token
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = False
                token = taken.pop()
                at -= size[token]
                last = taken[-1] if taken else -1
        return struct.pack(f"<{len(taken)}I", *taken)

    def _word(self, word: str) -> bytes:
        parts = self.special_re.split(word) if self.special_re is not None and "<|" in word else [word]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                part = unicodedata.normalize("NFC", part)
                # each letter by itself: no final sigma
                part = part.lower() if "Σ" not in part else "".join([c.lower() for c in part])
                out += [self.pieces[p] for p in self.piece_re.findall(part)]
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, split_words(text))), "<u4")


def _codec(definition: str) -> Codec:
    store, key = worker_store(), ("codec", hashlib.blake2b(definition.encode()).hexdigest())
    if key not in store:
        store[key] = Codec(definition)
    return store[key]


def _run(definition, keep: tuple[str, ...]):
    def run(batches):
        codec = _codec(definition.value)
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | {k: [] for k in keep}
            for x in batch.column(1):
                ids = codec.encode(x.as_py() or "")
                decoded = codec.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(codec.decimals(ids)).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if "ids" in keep:
                    out["ids"].append(ids.astype(np.int32))
                if "decoded" in keep:
                    out["decoded"].append(decoded.decode())
            types_ = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, types_.get(k, pa.string())) for k, v in out.items()], names=list(out))

    return run


def bpe_encode(docs: DataFrame, definition_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Token ids of every whole text and the text that these decode to.

    ``definition_path``: a tokenizer definition (JSON) on the driver; its text, of fixed size, is broadcast. Returns
    (doc_id, n_tokens, ids_sha256, decoded_sha256) and the columns in ``keep``: ``ids`` array<int>, ``decoded`` string.
    The digests are of the decimal ids joined by one space and of the decoded text. Null texts are empty: no ids, and
    the digests of nothing. Rows with a null id are kept. Strings of special tokens in a text become their ids, as in
    the tokenizer library. Repeated rows are encoded each; other columns are ignored.
    """
    with open(definition_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join({"ids": ", ids array<int>", "decoded": ", decoded string"}[k] for k in keep)
    return base.mapInArrow(_run(definition, keep), schema)


def _decode_run(definition):
    def run(batches):
        codec = _codec(definition.value)
        for batch in batches:
            text = [codec.decode(np.array(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "decoded"])

    return run


def bpe_decode(encoded: DataFrame, definition_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): token strings joined by one space; null or empty id lists decode to the empty text."""
    with open(definition_path, encoding="utf-8") as f:
        definition = encoded.sparkSession.sparkContext.broadcast(f.read())
    base = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(_decode_run(definition), "doc_id long, decoded string")
