"""Every operator on small hard cases, against plain Python versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scholarmill.llm import bpe, common, embedding_lsh, line_dedup, media, ngram_join, packing, quality, suffix_array, suffix_automaton, url_filter

DEFINITION = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=0, n=40):
    """Random texts with copies, near copies, shared passages, repeats, nulls, empty and very long ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = make(80)
    out = [None, "", " \t\n", "one", "One", "a b c d", "x" * 450, "ab " * 400, make(6000), passage]
    while len(out) < n:
        out.append(make(rng.randint(1, 200)))
    base = make(150).split()
    for k in range(12):
        near = list(base)
        near[rng.randrange(150)] = "changed"
        out.append(" ".join(near))
    out += [make(30) + "\n" + passage + "\n" + make(30) for _ in range(6)]
    out += [out[20], out[20], out[21].upper(), passage + " " + passage]
    return out


def frame(spark, values, start=0):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(start + k * 3, v, 1, "x", [1]) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, h string, spans array<int>").repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


class Union(dict):
    def find(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingles(text):
    words = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    values = texts(seed)
    ids = [k * 3 for k in range(len(values))]
    sets = dict(zip(ids, map(shingles, values), strict=True))
    groups = Union({i: i for i in ids})
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(frame(spark, values)).collect()}
    assert got == {i: (len(sets[i]), groups.find(i)) for i in ids}


def test_ngram_join_large_near_group(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    values = []
    for _ in range(120):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(60)] = f"z{rng.randrange(9)}"
        values.append(" ".join(near))
    ids = [k * 3 for k in range(len(values))]
    sets = dict(zip(ids, map(shingles, values), strict=True))
    groups = Union({i: i for i in ids})
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(frame(spark, values)).collect()}
    assert got == {i: groups.find(i) for i in ids}


def test_suffix_array_small():
    rng = random.Random(0)
    for _ in range(300):
        a = np.array([rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 30))], np.int64)
        assert suffix_array.suffix_order(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_array_dedup(spark, seed):
    values = texts(seed)
    data = {k * 3: (v or "").encode() for k, v in enumerate(values)}
    seen = {}
    for t in data.values():
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.suffix_array_dedup(frame(spark, values)).collect()}
    for i, t in data.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\x01" * 200
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert got[i] == (len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    values = texts(seed)
    data = {k * 3: WORD.findall(v or "") for k, v in enumerate(values)}
    first = {}
    for i in sorted(data):
        for k in range(len(data[i]) - 49):
            first.setdefault(tuple(data[i][k : k + 50]), i)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in suffix_automaton.substring_dedup(frame(spark, values)).collect()}
    for i, w in data.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        assert got[i][:3] == (len(w), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
        assert WORD.findall(got[i][3]) == left


def test_many_contexts_of_one_passage_are_dealt_in_parts(spark):
    """More contents of one anchor than a part holds."""
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(70))
    values = [" ".join(f"{rng.random():.9f}" for _ in range(20)) + " " + passage + " " + " ".join(f"{rng.random():.9f}" for _ in range(20)) for _ in range(30)]
    docs = frame(spark, values)
    base = docs.select("doc_id", "text")
    from scholarmill.llm import repeats

    spans = repeats.repeated_spans(base, suffix_automaton._tokenise, suffix_automaton._locate, suffix_automaton._decide(50), 50, 8, 4, True, "parts")
    got = {r.doc_id: repeats.union_spans([s.asDict() for s in r.spans], 10**6) for r in spans.collect()}
    assert got == {k * 3: [(20, 90)] for k in range(1, 30)}


@pytest.mark.parametrize("chunk", [4, 7])
def test_suffix_array_parts_of_one_anchor(spark, chunk):
    """More contents of one anchor than a part holds: a content that comes in several groups is no repeat of itself."""
    from scholarmill.llm import repeats

    rng = random.Random(4)
    # one rare 16-gram hash is the anchor of every window that holds it; contexts differ
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    values = ["".join(rng.choice("ijklmnop ") for _ in range(300)) + passage + "".join(rng.choice("ijklmnop ") for _ in range(300)) for _ in range(30)]
    base = frame(spark, values).select("doc_id", "text")
    spans = repeats.repeated_spans(base, suffix_array._tokenise, suffix_array._locate, suffix_array._decide(200), 200, 16, chunk, False, "suffix-parts")
    got = {r.doc_id: repeats.union_spans([s.asDict() for s in r.spans], 10**6) for r in spans.collect()}
    seen = {}
    for t in values:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    for k, t in enumerate(values):
        starts = [i for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1]
        assert got[k * 3] == [(starts[0], starts[-1] + 200)]


@pytest.mark.parametrize("parts", [1, 3])
def test_substring_dedup_of_repeated_rows(spark, parts):
    """A row that comes again loses nothing but what a smaller id holds, in one partition or several."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(5, a), (5, a), (5, a), (9, a), (9, a), (2, b), (2, b), (7, "x " + b), (7, "x " + b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts) if parts > 1 else spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept.strip()) for r in suffix_automaton.substring_dedup(docs).collect())
    assert got == sorted([(2, 60, 0, b)] * 2 + [(5, 60, 0, a)] * 3 + [(7, 61, 60, "x")] * 2 + [(9, 60, 60, "")] * 2)


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog and runs through the wide green forest until the evening falls down on all the land around it"
    values = [line + "\nfirst", "-- \n" + line.upper() + "!\nsecond\n-- ", None, "", line.replace("lazy", "lazi"), "second", "alone\nalone"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(frame(spark, values), similarity=0.9, distance=16).collect()}
    assert got[0] == (line + "\nfirst", 2, 0)
    assert got[3] == ("-- \nsecond\n-- ", 4, 1)
    assert got[6] == (None, 0, 0) and got[9] == ("", 1, 0)
    assert got[12] == ("", 1, 1) and got[15] == ("", 1, 1) and got[18] == ("alone", 2, 1)


def line_groups(spark, distinct, distance, similarity):
    """Groups of normalised lines (ASCII) linked by edit similarity and, with a distance, by SimHash; Spark's word hash is read from a table."""
    import duckdb
    from pyspark.sql import functions as F

    ordered = sorted(distinct)
    db = duckdb.connect()
    db.execute("CREATE TABLE x AS SELECT unnest(?) AS t", [ordered])
    most = f"floor(greatest(length(a.t), length(b.t)) * {1 - similarity} + 1e-9)"
    near = db.execute(f"SELECT a.t, b.t FROM x a JOIN x b ON a.t < b.t WHERE abs(length(a.t) - length(b.t)) <= {most} AND levenshtein(a.t, b.t) <= {most}").fetchall()
    sims = dict.fromkeys(ordered, 0)
    if distance is not None:
        hashes = {r.w: r.h & (2**64 - 1) for r in spark.createDataFrame([(w,) for line in distinct for w in line.split()], "w string").distinct().select("w", F.xxhash64("w").alias("h")).collect()}
        sims = {t: sum(1 << b for b in range(64) if 2 * sum(hashes[x] >> b & 1 for x in t.split()) > len(t.split())) for t in ordered}
    groups = Union({x: x for x in ordered})
    for a, b in near:
        if bin(sims[a] ^ sims[b]).count("1") <= (distance or 0):
            groups.join(a, b)
    return groups


def test_line_dedup_against_definition(spark):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    for k in range(60):
        w = lines[k].split()
        w[rng.randrange(len(w))] += rng.choice(["", "x"])
        lines.append(" ".join(w))
    rng.shuffle(lines)
    values = ["\n".join(lines[k : k + 4]) for k in range(0, len(lines), 4)]
    groups = line_groups(spark, set(lines), 6, 0.9)
    keep = {}
    expected = {}
    for k, v in enumerate(values):
        left = []
        for x in v.split("\n"):
            if groups.find(x) not in keep:
                keep[groups.find(x)] = True
                left.append(x)
        expected[k * 3] = "\n".join(left)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, values), distance=6).collect()}
    assert got == expected


def test_line_dedup_default_finds_edit_similar_lines(spark):
    """The production default against edit similarity alone: nearly every line with a changed word or letter is found."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    firsts, seconds = [], []
    for k in range(240):
        w = [rng.choice(words) for _ in range(rng.choice([5, 8, 12, 20, 26, 40, 100]))]
        firsts.append(" ".join(w))
        most, spent = len(firsts[-1]) // 10, 0
        for _ in range(1 + len(w) // 14):
            at = rng.randrange(len(w))
            new = rng.choice(words) if max(len(w[at]), 9) <= most - spent else w[at][:-1] + "z"
            spent += max(len(w[at]), len(new)) if new[:-1] != w[at][:-1] else 1
            w[at] = new
        seconds.append(" ".join(w))
    rows = [(k, x) for k, x in enumerate(firsts + seconds)]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    near = [k for k in range(240) if firsts[k] != seconds[k]]
    assert not any(got[k] for k in range(240)) and len(near) > 200
    assert sum(got[240 + k] for k in near) >= 0.95 * len(near)


@pytest.mark.parametrize("distance", [None, 6])
def test_line_dedup_of_repeated_rows(spark, distance):
    """A row that comes again changes nothing, in its own result or in that of others."""
    line = "a quick brown fox jumps over one lazy dog while nine other animals of the wood look on and say nothing at all"
    rows = [(1, line), (1, line), (2, line.replace("nine", "nime")), (2, line.replace("nine", "nime")), (3, "x\n" + line), (4, None), (4, None), (5, "!\n!"), (5, "!\n!"), (6, "y"), (6, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text or "", r.n_lines, r.n_removed) for r in line_dedup.line_dedup(docs, distance=distance and 30).collect())
    assert got == sorted([(1, line, 1, 0)] * 2 + [(2, "", 1, 1)] * 2 + [(3, "x", 2, 1)] + [(4, "", 0, 0)] * 2 + [(5, "!\n!", 2, 0)] * 2 + [(6, "y", 1, 0), (6, "z", 1, 0)])


def test_line_dedup_of_lines_that_repeat_themselves(spark):
    rows = [(1, "spam " * 40), (2, "spam " * 42), (3, "ham eggs " * 30), (4, "ham eggs " * 29 + "ham"), (5, "spam " * 60)]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_bpe_is_exact(spark):
    library = Tokenizer.from_file(DEFINITION)
    values = texts(7) + ["it's <|endoftext|>we'll, GO. Ünïcode İ, Σας x́́ 中文 12 \x1c a\xa0b", "aaaaaaaaaaaaaaaaaaaaaa", "ab<|startoftext|>."]
    got = {r.doc_id: r for r in bpe.bpe_encode(frame(spark, values), DEFINITION).collect()}
    for k, v in enumerate(values):
        ids = library.encode(v or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = got[k * 3]
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), text)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.bpe_encode(frame(spark, values), DEFINITION, keep=("ids",))
    assert {r.doc_id: r.decoded for r in bpe.bpe_decode(encoded, DEFINITION).collect()} == {i: r.decoded for i, r in got.items()}


def test_packing(spark):
    library = Tokenizer.from_file(DEFINITION)
    values = texts(8)
    rows = packing.best_fit_packing(frame(spark, values), DEFINITION, size=256).collect()
    expected = set()
    for k, v in enumerate(values):
        ids = [*library.encode(v or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 256)):
            piece = ids[at : at + 256]
            expected.add((k * 3, p, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in rows) // 256) + 2


def test_packing_encodes_words_together():
    library = Tokenizer.from_file(DEFINITION)
    encode = packing.Encoder(open(DEFINITION, encoding="utf-8").read())
    rng = random.Random(11)
    odd = ["<|endoftext|>", "a<|endoftext|>b", "<|startoftext|>.", "it's", "Σας", "İ", "x\u0301\u0301", "中文", "12,5", "\x1c", "a\xa0b", "<|", "|>", "!?", "ﬁ", "é", "𝒳"]
    values = [" ".join(rng.choice(odd) if rng.random() < 0.4 else "".join(rng.choice("abÀé.'<|>1 ") for _ in range(rng.randint(1, 9))) for _ in range(300)) for _ in range(40)]
    for lo in range(0, 40, 10):
        for v, ids in zip(values[lo : lo + 10], encode(values[lo : lo + 10]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(v, add_special_tokens=False).ids


def test_packing_encodes_a_word_once_whatever_its_case_and_stops(monkeypatch):
    library = Tokenizer.from_file(DEFINITION)
    encode, learned = packing.Encoder(open(DEFINITION, encoding="utf-8").read()), []
    real = encode.learn
    monkeypatch.setattr(encode, "learn", lambda words: (learned.extend(words), real(words)))
    values = ["Mill mill, MILL. mill.,", "É é, É. x\u0301, İ. İ, É..", "ΣΑΣ. Σας, <|endoftext|>. A<|endoftext|>a. <|ENDOFTEXT|>", "1. 1, it's. IT'S,", "e\u0301. E\u0301, ., .a ,A."]
    for v in values:
        assert np.frombuffer(encode([v])[0], "<u4").tolist() == library.encode(v, add_special_tokens=False).ids
        if v is values[0]:
            assert sorted(learned) == [",", ".", ".,", "mill"]


def test_packing_encodes_letters_once_whatever_marks_follow(monkeypatch):
    library = Tokenizer.from_file(DEFINITION)
    encode, letters, learned = packing.Encoder(open(DEFINITION, encoding="utf-8").read()), [], []
    real, real_letters = encode.learn, encode.learn_letters
    monkeypatch.setattr(encode, "learn", lambda words: (learned.extend(words), real(words)))
    monkeypatch.setattr(encode, "learn_letters", lambda words: (letters.extend(words), real_letters(words)))
    values = ["mill%%% Mill### mill!? (mill) mill", "stra\u00dfe, \u00e9t\u00e9... STRASSE;;", "a\x85b\u2003C.\u3000d \u2028 \x1cx \x0b y\x1f", "", " ", "<|endoftext|>! <|endoftext|>,a \u0130! e\u0301!!"]
    for v, ids in zip(values, encode(values), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(v, add_special_tokens=False).ids
    assert {"mill", "stra\u00dfe", "\u00e9t\u00e9", "strasse"} <= set(letters) and learned.count("mill") == 1
    assert not {w for w in learned if w[:4] in ("mill", "stra", "\u00e9t\u00e9") and not w.isalpha()}
    signs = [chr(c) for c in range(0x260) if not 0xD800 <= c < 0xE000]
    values = [f"{c} {c}{c} a{c} {c}a {c}.. {c}' '{c}s {c}\u0301 A{c}!" for c in signs]
    for v, ids in zip(values, encode(values), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(v, add_special_tokens=False).ids, v


def test_packing_plan_uses_exact_sums():
    assert packing.Sums(np.array([0, 1, 1, 1])).fill(3) == (3,)
    assert packing.Sums(np.array([0, 0, 0, 0, 2, 0, 0, 0, 0])).fill(8) == (4, 4)
    assert packing.Sums(np.array([0, 0, 0, 0, 1, 0, 0, 0, 0])).fill(8) is None
    rng = random.Random(1)
    for _ in range(200):  # against all sums of up to three
        counts = np.array([0, *(rng.choice([0, 0, 1, 2]) for _ in range(20))])
        sums, gap, held = packing.Sums(counts), rng.randint(1, 20), rng.randint(1, 20)
        if counts[held]:
            free = [x for x in range(21) for _ in range(counts[x] - (x == held))]
            every = [c for k in (1, 2, 3) for c in itertools.combinations(free[::-1], k) if sum(c) == gap]
            assert sums.fill(gap, (held,)) == (min((c for c in every if len(c) == min(map(len, every))), key=lambda c: [-x for x in c]) if every else None)
    for _ in range(60):
        counts = {rng.randint(1, 50): rng.randint(1, 30) for _ in range(rng.randint(1, 30))}
        used = {}
        for lengths, times in packing.plan(counts, 50):
            assert sum(lengths) <= 50 and times > 0
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == counts


def test_embedding_links(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16))
    x[50:90] = x[0] + 0.05 * rng.standard_normal((40, 16))
    x[90] = x[1] * 1e-200
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None]), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, x[1].tolist())]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, n long").repartition(4)
    got = {r.vec_id: r for r in embedding_lsh.embedding_near_dedup(df, block=16).collect()}
    valid = {k: np.array(v) / np.abs(v).max() for k, v in rows if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0}
    valid = {k: v / np.sqrt(v @ v) for k, v in valid.items()}
    links = {k: [j for j in valid if j != k and len(valid[j]) == len(valid[k]) and valid[j] @ valid[k] >= 0.9] if k in valid else [] for k, _ in rows}
    found = sum(got[k].n_links for k, _ in rows)
    assert found >= 0.97 * sum(map(len, links.values()))
    assert all(got[k].n_links <= len(links[k]) for k, _ in rows)
    assert got[1006].component_id == 1005 and not got[1006].kept and got[1007].component_id == 1
    assert all(got[k].component_id == 0 for k in range(50, 90))


def test_embedding_recall_and_equal_vectors(spark):
    """Recall at the threshold against brute force; equal vectors in large classes count as they should."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((400, 64))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    for cosine, least in ((0.9001, 0.9), (0.92, 0.95), (0.95, 0.99)):
        x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
        rows = [(k, v.tolist()) for k, v in enumerate(x)]
        got = {r.vec_id: r.component_id for r in embedding_lsh.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        assert sum(got[400 + k] == got[k] for k in range(400)) >= least * 400
    rows = [(k, base[k % 2].tolist()) for k in range(600)] + [(k, base[0].tolist()) for k in (0, 2, 4)] + [(900, None), (900, None)]
    out = embedding_lsh.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == [(k, 299, k % 2, k < 2) for k in range(600)] + [(900, 0, 900, True)]


def test_components(spark):
    edges = [(0, k) for k in range(1, 200)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5000, 5000), (None, 3)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {**{k: 0 for k in range(200)}, **{1000 + k: 1000 for k in range(151)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    captures = spark.createDataFrame([(1, "https://www.A.b.example.com:80/x", "2024-01-05"), (2, "http://b.example.com", "2024-01-01"), (3, None, "2024-01-05"), (4, "nonsense", "2024-01-05"), (5, "http://c.org/", None), (6, "http://a.b.example.com", "2024-01-20")], "page_id long, url string, fetched string")
    entries = spark.createDataFrame([("l", "b.example.com", "add", "2024-01-02"), ("l", "b.example.com", "add", "2024-01-03"), ("l", "b.example.com", "remove", "2024-01-10"), ("l", "example.com", "remove", "2024-01-01"), ("m", "A.b.example.com", "add", "2024-01-05"), ("m", "c.org", "add", "2024-01-01"), (None, "c.org", "add", "2024-01-01"), ("m", "c.org", "other", None)], "list string, key string, action string, ts string")
    entries = entries.selectExpr("list", "key", "action", "cast(ts as timestamp) ts")
    got = {r.page_id: (r.host, r.n_entries, r.lists, r.allowed) for r in url_filter.url_filter(captures, entries).collect()}
    assert got == {1: ("a.b.example.com", 2, "l,m", False), 2: ("b.example.com", 0, "", True), 3: ("", 0, "", True), 4: ("", 0, "", True), 5: ("c.org", 0, "", True), 6: ("a.b.example.com", 1, "m", False)}


def test_url_filter_against_definition(spark):
    """Random timelines over months, ties, repeated captures, clashing columns."""
    import datetime as dt

    rng = random.Random(3)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 100))
    hosts = ["a.x.org", "b.x.org", "x.org", "y.com"]
    entries = [(rng.choice("lmn"), rng.choice(hosts), rng.choice(["add", "remove"]), day()) for _ in range(160)]
    captures = [(k, f"http://{rng.choice(hosts)}/{k}", day(), "x") for k in range(80)] + [(200, None, day(), "x"), (201, "http://y.com", None, "x")]
    captures += captures[:5]
    got = url_filter.url_filter(spark.createDataFrame(captures, "page_id long, url string, fetched timestamp, list string").repartition(3), spark.createDataFrame(entries, "list string, key string, action string, ts timestamp")).collect()
    expected = set()
    for page, url, at, _ in captures:
        host = (url or "//").split("/")[2] if url else ""
        keys = {host, "x.org"} if host.endswith(".x.org") else {host}
        active = []
        for name in "lmn":
            for key in keys:
                past = [(ts, action) for n, k, action, ts in entries if n == name and k == key and at and ts <= at]
                if past and max(past)[1] == "add":  # of both at one time the removal counts
                    active.append(name)
        expected.add((page, host, len(active), ",".join(sorted(set(active))), not active))
    assert len(got) == len(expected) and {(r.page_id, r.host, r.n_entries, r.lists, r.allowed) for r in got} == expected
    none = spark.createDataFrame([], "list string, key string, action string, ts timestamp")
    assert url_filter.url_filter(spark.createDataFrame(captures, "page_id long, url string, fetched timestamp, list string"), none).where("NOT allowed").count() == 0
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string, fetched timestamp"), none).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["qqq!!", "zzz!!", "xxx!!"]
    rows = [(k, " ".join(rng.choice(good if k % 3 else bad) for _ in range(30)), int(k % 3 > 0)) for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "again " * 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows] + [(5000, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, cells=1 << 12, per_class=50)
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, model).collect()}
    assert len(scores) == 303 and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[k] >= 0.5) == bool(y) for k, _, y in rows)
    assert scores[900] == scores[901]
    kept = quality.keep_good(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.where("doc_id < 900").count() == 200


def test_media(spark):
    page = '<title>T &amp; x</title><script>no</script><p>one<b> two</b><!-- c --><figure><img src="u1" alt="a1"><figcaption>cap &lt;1&gt;</figcaption></figure>three<img alt=a2 data-digest="d2"><p>four < five'
    assert media.sequence(page) == [("text", "T & x", None, None), ("text", "one two", None, None), ("media", None, hashlib.sha256(b"u1").hexdigest(), "cap <1>"), ("text", "three", None, None), ("media", None, "d2", "a2"), ("text", "four < five", None, None)]
    assert media.sequence("") == []
    for size in (192, 384, 192 * 100):
        payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
        assert media.from_image(media.to_image(payload)).tobytes() == payload


def test_media_query(spark, tmp_path):
    from scholarmill.llm import queries

    values = texts(9) + ["<p>&amp; </article> <img src='x'>"]
    frame(spark, values).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op10_media_columns(spark, str(tmp_path)).collect()
    assert len(rows) == len(values)
    by = {r.doc_id: r for r in rows}
    for k, v in enumerate(values):
        data = (v or "").encode()
        padded = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = by[k * 3]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert by[0].feature == by[3].feature and by[0].media_sha256 == by[3].media_sha256


def test_empty_tables(spark):
    docs = empty(spark)
    assert ngram_join.ngram_jaccard_join(docs).count() == 0
    assert suffix_array.suffix_array_dedup(docs).count() == 0
    assert suffix_automaton.substring_dedup(docs).count() == 0
    assert line_dedup.line_dedup(docs).count() == 0
    assert bpe.bpe_encode(docs, DEFINITION).count() == 0
    assert packing.best_fit_packing(docs, DEFINITION).count() == 0
    assert embedding_lsh.embedding_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"), cells=64)
    assert quality.quality_scores(docs, model).count() == 0
    assert media.interleave(docs, "doc_id", "text").count() == 0
