"""Best-fit packing of token sequences into as few sequences of a fixed size as it can.

Only the histogram of piece lengths (as many rows as the sequence size) decides: it comes to the driver, where sums
of one, two and three available lengths that fill a gap exactly are consumed as often as availability allows, and
what remains is packed best-fit. The plan says, for each length, which ranks go where. Pieces get their rank among
equal lengths from per-partition counts, so that every piece finds its place by itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import split_words, worker_store
from .common import materialise, slices, small_batches, utf8

#: Text bytes whose words are encoded together.
ENCODED_BYTES = 8 << 20
#: Words remembered in one of two generations, at some 200 bytes each.
ENCODED_WORDS = 600_000
# A definition of this form lower-cases texts and parts a letter from a mark behind it
_FOLDS = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_FAR = re.compile("[^\x00-\u024f]|<\\|")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# White space beyond ASCII, at which words part too
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Sums:
    """Index of the sums of one, two and three available lengths, under availability counts that only fall.

    Pairs stand by their sum, the one with the largest length last; triples are a single length and the pair that the
    index has for the rest. Pairs of which a length has run out are dropped when they are met at the end of their list.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        lengths = np.flatnonzero(counts)
        small, big = (lengths[i] for i in np.triu_indices(len(lengths)))
        fits = small + big < len(counts)
        small, big = small[fits], big[fits]
        order = np.lexsort((big, small + big))
        self.small, self.big = small[order], big[order]
        at = np.searchsorted(self.small + self.big, np.arange(len(counts) + 1))
        self.begin, self.end = at[:-1], at[1:].copy()

    def single(self, gap: int, held: tuple[int, ...]) -> bool:
        return 0 < gap < len(self.counts) and self.counts[gap] > held.count(gap)

    def pair(self, gap: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        if not 1 < gap < len(self.counts):
            return None
        begin, end, counts = self.begin[gap], self.end[gap], self.counts
        while end > begin and not (counts[self.small[end - 1]] and counts[self.big[end - 1]]):
            end -= 1
        self.end[gap] = end
        for k in range(end - 1, begin - 1, -1):
            a, b = int(self.big[k]), int(self.small[k])
            if counts[b] > held.count(b) and counts[a] > held.count(a) + (a == b):
                return a, b
        return None

    def fill(self, gap: int, held: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to ``gap``, the largest first, beside the ``held`` ones."""
        if self.single(gap, held):
            return (gap,)
        found = self.pair(gap, held)
        if found or gap < 3:
            return found
        for a in np.flatnonzero(self.counts[: gap - 1])[::-1].tolist():
            if 3 * a < gap:
                break
            rest = self.pair(gap - a, (*held, a)) if self.single(a, held) else None
            if rest:
                return (a, *rest)
        return None


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for all pieces of the histogram."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(counts[x]) // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= k * times
        out.append((lengths, times))

    if counts[size]:
        consume((size,))
    sums = Sums(counts)
    for length in range(size - 1, 0, -1):
        while counts[length] > 0:
            rest = sums.fill(size - length, (length,))
            if rest is None:
                break
            consume((length, *rest))
    while counts.any():
        length = int(np.flatnonzero(counts)[-1])
        took, gap = [length], size - length
        counts[length] -= 1
        while gap > 0 and len(fit := np.flatnonzero(counts[: gap + 1])):
            took.append(int(fit[-1]))
            counts[fit[-1]] -= 1
            gap -= int(fit[-1])
        for x in took:
            counts[x] += 1
        consume(tuple(took))
    return out


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: rank r >= first goes to first sequence + r - first."""
    rows, rank, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, rank.get(x, 0), sequence, offset))
            rank[x] = rank.get(x, 0) + times
            offset += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _folds(definition: dict) -> bool:
    steps = [x["type"] for x in (definition.get("normalizer") or {}).get("normalizers", [])]
    patterns = [x.get("pattern", {}).get("Regex") for x in (definition.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return (steps, next(iter(patterns), None)) == _FOLDS


def _closing(definition: dict) -> np.ndarray | None:
    """Which tokens close a word; null where the form of the definition doesn't let every word of letters end in one."""
    from tokenizers.pre_tokenizers import ByteLevel

    model, bytes_ = definition["model"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    end, vocab = model.get("end_of_word_suffix"), model["vocab"]
    after = (definition["pre_tokenizer"].get("pretokenizers") or [])[1:] if _folds(definition) else []
    plain = len(after) == 1 and bytes_.items() <= after[0].items() and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
    if not plain or model["type"] != "BPE" or not end or any(c not in vocab or c + end not in vocab for c in ByteLevel.alphabet()):
        return None
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for token, i in vocab.items() if token.endswith(end)]] = True
    return out


class Encoder:
    """Texts -> their ids as bytes, by the tokenizer library. What is new in a slice of texts is encoded together.

    Words are remembered in two generations of bounded size, for as long as the Python worker lives; a slice asks once for
    each of its words. Where the definition lower-cases, so are texts of Latin letters that stay composed, before they are
    cut; words with marks at their end then are the word and these, and words of letters alone go to the library's model
    past its normaliser and pattern, which would not change them.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        special = [(t.content, i) for i, t in sorted(self.library.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.border = special[0] if special else None
        form = json.loads(definition)
        self.folds, self.closing = _folds(form), _closing(form)
        self.plain = Tokenizer.from_str(definition)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer = None
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encodes words, some hundred at once with a special token between them; words that hold one go alone."""
        if self.closing is not None:
            letters = [w for w in words if w.isalpha() and w.islower() and max(w) < "\u0250"]
            self.learn_letters(letters)
            words = list(set(words).difference(letters))
        if self.border is None:
            alone, together = words, []
        else:
            sign, number = self.border
            alone, together = [w for w in words if "<|" in w], [w for w in words if "<|" not in w]
            parts = [together[k : k + 500] for k in range(0, len(together), 500)]
            for part, found in zip(parts, self.library.encode_batch_fast([sign.join(p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, "<u4")
                at = np.concatenate([[-1], np.flatnonzero(ids == number), [len(ids)]])
                data = ids.tobytes()
                for w, x, y in zip(part, (4 * at[:-1] + 4).tolist(), (4 * at[1:]).tolist(), strict=True):
                    self.now[w] = data[x:y]
        for w in alone:
            self.now[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_letters(self, words: list[str]) -> None:
        """Encodes words of small Latin letters, some hundred at once; a token that closes a word is its last."""
        parts = [words[k : k + 500] for k in range(0, len(words), 500)]
        for part, found in zip(parts, self.plain.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            at, data, x = (4 * np.flatnonzero(self.closing[ids]) + 4).tolist(), ids.tobytes(), 0
            for w, y in zip(part, at, strict=True):
                self.now[w], x = data[x:y], y

    def lowered(self, text: str) -> str:
        """The text, lower-cased where that cannot change its tokens."""
        if not self.folds or ("<|" in text if text.isascii() else _FAR.search(text)):
            return text
        low = text.lower()
        return low if low.isascii() or unicodedata.is_normalized("NFC", low) else text

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        if len(self.now) > ENCODED_WORDS:
            self.now, self.before = {}, self.now
        found = list(map(self.now.get, words))
        missing = {w for w, ids in zip(words, found, strict=True) if ids is None}
        if not missing:
            return found
        again = missing.intersection(self.before)
        self.now.update(zip(again, map(self.before.__getitem__, again), strict=True))
        missing -= again
        cut = {w: (stem, w[len(stem) :]) for w in missing if self.folds and w[-1:] in _MARKS and (stem := w.rstrip(_MARKS)) and stem[-1].lower()[-1].isalpha() and "<|" not in w}
        parts = {p for both in cut.values() for p in both}.difference(self.now)
        again = parts.intersection(self.before)
        self.now.update(zip(again, map(self.before.__getitem__, again), strict=True))
        self.learn(list((missing.difference(cut) | parts) - again))
        self.now.update((w, self.now[stem] + self.now[end]) for w, (stem, end) in cut.items())
        return [self.now[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        low = [x if x.isascii() or not _WIDE.search(x) else " ".join(split_words(x)) for x in map(self.lowered, texts)]
        words = pc.ascii_split_whitespace(pa.array(low, pa.large_string()))
        coded = words.values.dictionary_encode()
        found = self.known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.array([len(x) for x in found], np.int64) // 4
        table, code = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
        count = size[code]
        end = np.append(0, np.cumsum(count))
        ids = table[np.repeat((np.cumsum(size) - size)[code] - end[:-1], count) + np.arange(end[-1])].tobytes()
        at = (4 * end[words.offsets.to_numpy()]).tolist()
        return [ids[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _pieces(definition, size: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        store, text = worker_store(), definition.value
        key = ("library", hashlib.blake2b(text.encode()).hexdigest())
        if key not in store:
            store[key] = Encoder(text)
        encode = store[key]
        part, seen, end = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            _, off = utf8(batch.column(1))
            docs = batch.column(0).to_pylist()
            for lo, hi in slices(off, ENCODED_BYTES):
                for doc, ids in zip(docs[lo:hi], encode([x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        piece = ids[at : at + 4 * size]
                        n = len(piece) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(piece), part, int(seen[n])))
                        seen[n] += 1
            if rows:
                types_ = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types_, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def _place(table):
    def run(batches):
        rows = table.value
        key = (rows[:, 0] << 44) + rows[:, 1]
        for b in batches:
            length, rank = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("rank")).to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            sequence = rows[at, 2] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(sequence), pa.array(rows[at, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def best_fit_packing(docs: DataFrame, definition_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every document's tokens, followed by ``end_id``, into sequences of at most ``size`` tokens.

    Longer documents are cut into pieces of ``size`` tokens, the last one shorter; others stay whole. Returns one row
    for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset). Null and empty texts are one piece
    of one token. Repeated rows are packed each; rows with a null id keep it. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(definition_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = materialise(base.mapInArrow(_pieces(definition, size, end_id), schema + ", part long, nth long"), "packing-pieces")
    per_part = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    table = spark.sparkContext.broadcast(placements(plan(histogram, size)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base_rank = materialise(per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-ranks")
    # a merge join: these counts grow with the partitions, so they are not broadcast
    ranked = pieces.join(base_rank.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(table), schema + ", sequence_id long, offset long")
