"""Decontamination, fill-in-the-middle and spelling variants on hard cases, against plain Python versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholarmill.llm import decontaminate, fill_in_middle, spelling

from .test_operators import empty, frame, texts

LOWER = {k: k + 32 for k in range(65, 91)}
MARKED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return MARKED.findall((text or "").translate(LOWER))


def plain_hits(values, items, window=10):
    """id -> (n_words, hit places, item ids) for documents numbered as ``frame`` does."""
    asked = {}
    for item, text in items:
        w = words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w else 0):
            asked.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = {}
    for k, text in enumerate(values):
        w, hit, found = words(text), set(), set()
        for size in {len(a) for a in asked}:
            for i in range(len(w) - size + 1):
                ids = asked.get(tuple(w[i : i + size]))
                if ids:
                    hit.update(range(i, i + size))
                    found |= ids
        out[k * 3] = (len(w), sorted(hit), sorted(found))
    return out


def leaky(seed):
    rng = random.Random(seed)
    values = texts(seed)
    make = lambda k: " ".join(rng.choice(["Ab", "cé", "d1", "é", "x", "yz", "w-w", "1,2"]) for _ in range(k))
    items = [(1, None), (2, ""), (3, " ., "), (4, make(40)), (4, make(12)), (5, make(9)), (6, make(10)), (7, "same words are here"), (8, "Same-words are HERE!"), (11, make(3)), (12, "one"), (13, make(5)), (None, make(20))]
    items += [(20 + k, values[20 + k]) for k in range(6)]
    long = [words(t) for _, t in items if t]
    for w in long * 2:
        a = rng.randrange(max(1, len(w) - 9))
        values.append(" ".join([*make(rng.randrange(9)).split(), *w[a : a + rng.randint(8, 14)], "tail", *w[:3]]))
    return [*values, " ".join(long[2]) * 3, "same\nwords are here same words are here"], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontaminate(spark, seed):
    values, items = leaky(seed)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, class string, h int")
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, values), table).collect()}
    kept = [(i, t) for i, t in items if i is not None]
    for i, (n, hit, found) in plain_hits(values, kept).items():
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated) == (n, len(hit), found, len(found), bool(hit))
        assert [p for s in r.spans for p in range(s.start, s.end)] == hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert len(got) == len(values)


def test_decontaminate_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "b"), (None, "a b c d"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "b c"), (7, "b c")], "item_id long, text string")
    rows = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, items).collect())
    assert rows == [(1, 1, 0, []), (1, 4, 2, ["7"]), (1, 4, 2, ["7"]), (2, 0, 0, [])]
    assert {r.n_hit for r in decontaminate.decontaminate(docs, items.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(empty(spark), items).count() == 0


def test_every_shared_window_has_a_shared_fingerprint():
    import numpy as np

    from scholarmill.llm.common import Rolling

    rng, rolling = np.random.default_rng(1), Rolling()
    for _ in range(50):
        a, b = (rng.integers(0, 4, 60).astype(np.uint64) for _ in range(2))
        b[20:30] = a[5:15]
        ends = np.array([0, 60])
        (pa, ha), (pb, hb) = (decontaminate._winnow(x, ends, 10, 5, rolling) for x in (a, b))
        mine = {(p - 5, h) for p, h in zip(pa.tolist(), ha.tolist(), strict=True) if 5 <= p <= 10}
        other = {(p - 20, h) for p, h in zip(pb.tolist(), hb.tolist(), strict=True) if 20 <= p <= 25}
        assert mine & other


def plain_fim(doc_id, text, seed=7, rate=100, share=50, unit=fill_in_middle.LINE):
    text = text or ""
    lines = re.findall(unit, text)
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < share:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rng = random.Random(5)
    some = ["\n", "\n\n\n", "a", "a\n", "\na", "a\r\nb\r\n", "$1 \\1 $0\n\\E{2}\nx", "<P\n>", "<\nP>", "x<P>y", "<M>", "<S", "é😀\n😀 z\x85\n", "tab\t\n", "\x00\n\x00"]
    some += ["".join(rng.choice("ab\n<>PSM😀") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    return [None, "", *some, "line\n" * 30000, "x" * 300000 + "\n" + "y" * 1000, *texts(1)]


@pytest.mark.parametrize("options", [{}, {"rate": 60, "spm_share": 20, "seed": 11}, {"unit": r"(?s)."}])
def test_fill_in_middle(spark, options):
    values = fim_texts() if "unit" not in options else [v for v in fim_texts() if v is None or len(v) < 5000]
    rows = [(k, v, 1, "x", "key") for k, v in enumerate(values)] + [(3, values[3], 1, "x", ""), (None, "q\nr\ns", 1, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string, output string").repartition(4)
    made = fill_in_middle.fill_in_middle(docs, **options).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect())
    names = {"seed": "seed", "rate": "rate", "spm_share": "share", "unit": "unit"}
    plain = {names[k]: v for k, v in options.items()}
    assert got == Counter((i, *plain_fim(i, t, **plain), t or "") for i, t, *_ in rows)
    assert fill_in_middle.fill_in_middle(empty(spark)).count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows, noise, length, count):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if i is not None and h % noise == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= count}
    form, near = {}, {}
    for w in n:
        close = [v for v in n if one_edit(w, v)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], near[w], n.get(form[w]))
    return out


@pytest.mark.parametrize("index_words", [spelling.INDEX_WORDS, 7])
def test_spelling_variants(spark, index_words):
    rng = random.Random(index_words)
    base = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "x" * 400, "x" * 401]

    def word():
        w = list(rng.choice(base))
        if rng.random() < 0.4:
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["b", w[k]], ["é"], [w[k], w[k]]])
        return "".join(w)

    rows = [(None if k % 11 == 0 else k % 90, " ".join(word().upper() if rng.random() < 0.1 else word() for _ in range(40)) + rng.choice([". a-b", "…", "\n"])) for k in range(100)]
    rows += [(200, None), (201, ""), (202, "aaaaa " * 50), (202, "aaaaa " * 50)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string").repartition(4)
    found = spelling.spelling_variants(docs, noise=5, index_words=index_words).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == plain_variants(rows, 5, 5, 3)
    assert len(found) == len({r.word for r in found})
    assert spelling.spelling_variants(empty(spark)).count() == 0


def test_words_one_edit_apart_are_found_once(spark):
    rng = random.Random(9)
    some = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(2, 7))) for _ in range(150)})
    table = spark.createDataFrame([(w, 1) for w in some], "word string, n long").repartition(3)
    got = Counter((r.word, r.near) for r in spelling.near_pairs(table, index_words=20).collect())
    assert got == Counter((a, b) for a in some for b in some if one_edit(a, b))
