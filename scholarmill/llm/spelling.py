"""Spelling variants: words one edit apart, found by search schemes over an FM-index with both directions.

Of two words one edit apart one half of the first stands unchanged in the other, at its end or its start. A word is
therefore asked twice: with its right half matched exactly and one error in the left half, and, over the index of the
reversed words, the other way round. The vocabulary lies in the index as ``$word$word$``; an interval of suffix ranks
that ends in ``$`` names a word by its rank. The vocabulary is dealt out by halves, so that a word meets the index
that holds every word with its half; an index never holds much more than a fixed number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .suffix_array import suffix_order

#: Runs of letters that count as words.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Words of one index; a half that more words share is dealt out in blocks of about so many.
INDEX_WORDS = 1 << 16
_END, _DELIMITER, _LETTER = 1, 2, 3


class Direction:
    """FM-index of the words of one direction: ranks of suffixes, extended to the left by one letter at a time."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        flat, off = _codes(words)
        self.letters = np.unique(flat)
        n = len(words)
        text = np.full(len(flat) + n + 2, _DELIMITER, np.int64)
        text[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(off)) + 1] = np.searchsorted(self.letters, flat) + _LETTER
        text[-1] = _END
        order = suffix_order(text)
        self.size = len(text)
        self.before = text[order - 1]
        by_letter = np.argsort(self.before, kind="stable")
        self.ranks = self.before[by_letter] * self.size + by_letter
        # suffixes that start with a delimiter come after the end mark's; the last delimiter's comes first among them
        self.delimited = 1, n + 2
        starts = np.append(0, off[1:] + np.arange(1, n + 1))
        self.word_at = np.searchsorted(starts, order[2 : n + 2])

    def code(self, letters: np.ndarray) -> np.ndarray:
        """Codes of letters; 0, which is never found, for a letter that no word has."""
        at = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        return np.where(self.letters[at] == letters, at + _LETTER, 0)

    def extend(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank intervals of the strings with one letter before those of [lo, hi)."""
        return np.searchsorted(self.ranks, code * self.size + lo), np.searchsorted(self.ranks, code * self.size + hi)

    def letters_before(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, code) for every letter that stands before a suffix of an interval."""
        top = len(self.letters) + _LETTER
        wide = np.flatnonzero(hi - lo > top)
        narrow = np.flatnonzero(hi - lo <= top)
        size = (hi - lo)[narrow]
        place = np.repeat(narrow, size)
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[place]
        pair = np.unique(place * top + self.before[row])
        pair = np.concatenate([pair[pair % top >= _LETTER], (wide[:, None] * top + np.arange(_LETTER, top)).ravel()])
        return pair // top, pair % top

    def one_edit(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for every word that ends in the last ``exact`` letters of a query and is one edit of the rest away."""
        flat, off = _codes(queries)
        code = np.append(self.code(flat), 0)
        start, left = off[:-1], np.diff(off)
        query = np.arange(len(queries))
        lo, hi = (np.full(len(queries), v) for v in self.delimited)
        rest = left - exact
        while len(query) and (left > rest[query]).any():
            on = left > rest[query]
            lo[on], hi[on] = self.extend(code[start[query[on]] + left[on] - 1], lo[on], hi[on])
            left = left - on
            query, lo, hi, left = _alive(query, lo, hi, left)
        found = []
        while len(query):
            state, letter = self.letters_before(lo, hi)
            q, rem = query[state], left[state]
            own = np.where(rem > 0, code[start[q] + rem - 1], 0)
            differs = letter != own
            lo2, hi2 = self.extend(letter[differs], lo[state[differs]], hi[state[differs]])
            q, rem = q[differs], rem[differs]
            found.append((q, lo2, hi2, rem))  # a letter more; one equal to the next is the same word with that letter twice
            replaced = rem > 0
            found.append((q[replaced], lo2[replaced], hi2[replaced], rem[replaced] - 1))
            on = left > 0
            query, lo, hi, left = query[on], lo[on], hi[on], left[on]
            own = code[start[query] + left - 1]
            first = (left == 1) | (code[start[query] + left - 2] != own)  # of equal letters the first is the one left out
            found.append((query[first], lo[first], hi[first], left[first] - 1))
            lo, hi = self.extend(own, lo, hi)
            query, lo, hi, left = _alive(query, lo, hi, left - 1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, lo, hi, left = _alive(*(np.concatenate([f[k] for f in found]) for k in range(4)))
        done = []
        while len(query):
            at_start = left == 0
            lo0, hi0 = self.extend(np.full(at_start.sum(), _DELIMITER), lo[at_start], hi[at_start])
            size = hi0 - lo0
            row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo0, size)
            done.append((np.repeat(query[at_start], size), self.word_at[row - 2]))
            query, lo, hi, left = query[~at_start], lo[~at_start], hi[~at_start], left[~at_start]
            lo, hi = self.extend(code[start[query] + left - 1], lo, hi)
            query, lo, hi, left = _alive(query, lo, hi, left - 1)
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one after another, and where each word starts."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return flat, np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)


def _alive(query, lo, hi, left):
    on = lo < hi
    return query[on], lo[on], hi[on], left[on]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 97, min_length: int = 5, min_count: int = 3, letters: str = LETTERS) -> DataFrame:
    """(word, n) of the letter runs of all whole texts, A-Z lower-cased, with ``min_length`` letters and ``min_count`` occurrences.

    A run loses the letter at ``h % length`` where ``noise`` divides h, the checksum of ``doc_id:run``. Null texts have
    no words; the runs of a row with a null id lose no letter. A row that comes again counts again.
    """
    run = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(letters), F.lit(0))).alias("run")).where(F.length("run") >= min_length)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", upper, lower))
    run = run.select("id", low.alias("run"))
    run = run.select("run", F.crc32(F.concat_ws(":", F.col("id").cast("string"), "run")).alias("h"), F.col("id").isNotNull().alias("known"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("known") & (F.col("h") % noise == 0), cut).otherwise(F.col("run"))
    return run.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _dealt(words: DataFrame, index_words: int) -> DataFrame:
    """Index (kind 0) and query rows of every word for both halves: (side, k, b, kind, word, n, exact)."""
    size = F.length("word")
    shorter, same, longer = (F.col("size") - 1, F.col("size"), F.col("size") + 1)
    # side 0: the left half is exact, words are reversed; side 1: the right half
    halves = lambda f: F.array_distinct(F.array(*(f(x) for x in (shorter, same, longer))))
    left, right = lambda x: F.floor(x / 2).cast("int"), lambda x: F.ceil(x / 2).cast("int")
    sides = []
    words = words.select("word", "n", size.alias("size"))
    for side, half in ((0, left), (1, right)):
        shown = words.select(F.lit(side).alias("side"), (F.reverse("word") if side == 0 else F.col("word")).alias("word"), "n", "size")
        index = shown.select("side", F.lit(0).alias("kind"), "word", "n", F.explode(halves(half)).alias("exact")).where("exact > 0")
        asked = shown.select("side", F.lit(1).alias("kind"), "word", "n", half(F.col("size")).alias("exact"))
        sides += [index, asked]
    rows = sides[0].unionAll(sides[1]).unionAll(sides[2]).unionAll(sides[3])
    rows = rows.withColumn("k", F.xxhash64("side", "exact", F.expr("right(word, exact)")))
    busy = rows.where("kind = 0").groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") > index_words)
    busy = busy.select("k", F.ceil(F.col("m") / index_words).cast("int").alias("parts"))
    rows = rows.join(busy, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    blocks = F.when(F.col("kind") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return rows.select("side", "k", F.explode(blocks).alias("b"), "kind", "word", "n", "exact")


def near_pairs(words: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """(word, near, n): every two words of ``words(word, n)`` that differ by one inserted, deleted or replaced letter, both ways.

    ``n`` is the count of ``near``. Words must be distinct, not null, and of two letters or more.
    """

    def run(batches):
        held = _Chunk(index_words)
        for batch in batches:
            yield from held.take(batch)
        yield from held.close()

    dealt = _dealt(words, index_words).repartition(F.col("side"), F.col("k"), F.col("b")).sortWithinPartitions("side", "k", "b", "kind")
    return dealt.mapInArrow(run, "word string, near string, n long")


class _Chunk:
    """Rows of a task in order: index words of whole groups until there are enough, and the queries of these groups."""

    MOST_QUERIES = 1 << 15

    def __init__(self, index_words: int) -> None:
        self.limit = index_words
        self.last = None
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, tuple[int, set]] = {}
        self.queries: list[tuple[str, int, tuple]] = []
        self.built: Direction | None = None

    def take(self, batch: pa.RecordBatch):
        side, k, b, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        word, n, exact = (batch.column(i).to_pylist() for i in range(4, 7))
        for i in range(batch.num_rows):
            group = (side[i], k[i], b[i])
            if group != self.last:
                if self.built is not None or len(self.index) >= self.limit or (self.last is not None and self.last[0] != side[i]):
                    yield from self.close()
                self.last = group
            if kind[i] == 0:
                known = self.index.get(word[i])
                if known is None:
                    self.index[word[i]] = n[i], {group}
                else:
                    known[1].add(group)
            else:
                self.queries.append((word[i], exact[i], group))
                if len(self.queries) >= self.MOST_QUERIES:
                    yield from self._answer()

    def close(self):
        yield from self._answer()
        self._reset()

    def _answer(self):
        if not self.queries or len(self.index) < 2:
            self.queries = []
            return
        if self.built is None:
            self.built = Direction(list(self.index))
        words = [q[0] for q in self.queries]
        exact = np.array([q[1] for q in self.queries], np.int64)
        a, b = self.built.one_edit(words, exact)
        out = []
        back = self.queries[0][2][0] == 0
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            one, tail, group = self.queries[i]
            two = self.built.words[j]
            n, groups = self.index[two]
            # a word of another group is found there; a word with both halves was found by the left one
            if group not in groups or (not back and two.startswith(one[: len(one) - tail])):
                continue
            out.append((one[::-1], two[::-1], n) if back else (one, two, n))
        self.queries = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), pa.array([o[2] for o in out], pa.int64())], names=["word", "near", "n"])


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 97, min_length: int = 5, min_count: int = 3, ratio: int = 2, index_words: int = INDEX_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary (see ``vocabulary``).

    Two words are near if one inserted, deleted or replaced letter makes one of the other. A word's ``form`` is its near
    word of largest count (of equal counts the first in code-point order), if that is at least ``ratio`` times its own
    count; ``root`` is where forms lead in the end, the word itself without one. Repeated rows count, null and empty
    texts have no words, an empty table gives no rows, other columns are ignored.
    """
    words = materialise(vocabulary(docs, id_col, text_col, noise, min_length, min_count), "spelling-words")
    near = near_pairs(words, index_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    found = words.join(near, "word", "left")
    fits = -F.col("best")["m"] >= ratio * F.col("n")
    found = found.select("word", F.when(fits, F.col("best")["form"]).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best")["m"]).alias("form_n"))
    found = materialise(found, "spelling-forms")
    # counts grow along forms, so there are no rings: pointers double until all stand on a word without a form
    root = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        root = materialise(root.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if root.where("moved").isEmpty():
            break
        root = root.select("word", "root")
    return found.join(root.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
