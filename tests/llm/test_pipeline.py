"""The corpus pipeline, stage by stage, against plain versions of the stages on what each one was given."""

import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from scholarmill.llm import quality

from .test_operators import WORD, Union, line_groups, shingles


def make(spark, folder):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    passage, line = text(70), text(30)
    near = text(120).split()
    for k in range(120):
        if k % 6 == 0:
            t, good = " ".join(f"{rng.choice(words).upper()}!!" for _ in range(40)), 0
        else:
            t, good = "\n".join(text(rng.randint(5, 60)) for _ in range(rng.randint(1, 4))), 1
            if k % 7 == 0:
                t += " " + passage + " " + text(5)
            if k % 5 == 0:
                t += "\n" + line
            if k % 11 == 0:
                w = list(near)
                w[rng.randrange(120)] = "other"
                t = "\n".join(" ".join(w[i : i + 40]) + f" {k}" for i in range(0, 120, 40))
        docs.append((k, t, "en", "s", len(t)))
        labels.append((k, good, 0))
    docs += [(200, docs[1][1], "en", "s", 1), (201, "", "en", "s", 0), (202, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return labels


def read(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    labels = make(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, given, k = docs.columns, docs, 0
    made = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, folder)
        out.write.parquet(f"{folder}/stage-{k}")
        made.append(spark.read.parquet(f"{folder}/stage-{k}"))
        given, k = made[-1], k + 1
    assert all(m.columns == columns for m in made[:-1])

    # quality: what scores high stays as it was; clean documents are kept and rejected ones are gone
    before, kept = read(docs), read(made[0])
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, model).collect()}
    assert kept == {i: t for i, t in before.items() if scores[i] >= 0.3}
    assert all((i in kept) == bool(good) for i, good, _ in labels)

    # lines: none is said twice any more, the first one stays, nothing else is lost
    norm = lambda x: " ".join(re.findall(r"[^\W_]+", x.lower()))
    same = line_groups(spark, {norm(x) for t in kept.values() for x in (t or "").split("\n")} - {""}, None, 0.9)
    lines, said = read(made[1]), set()
    for i in sorted(kept):
        left = []
        for x in (kept[i] or "").split("\n"):
            key = norm(x) and same.find(norm(x))
            if not key or key not in said:
                left.append(x)
            said.add(key)
        if kept[i] is None:
            assert lines[i] is None
        elif "\n".join(left).strip() or kept[i] == "":
            assert lines[i] == "\n".join(left)
        else:
            assert i not in lines

    # near-duplicates: one of each group
    sets = {i: shingles(t) for i, t in lines.items()}
    groups = Union({i: i for i in sets})
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    single = read(made[2])
    assert single == {i: t for i, t in lines.items() if groups.find(i) == i}

    # passages
    passages, first = read(made[3]), {}
    for i in sorted(single):
        w = WORD.findall(single[i] or "")
        for at in range(len(w) - 49):
            first.setdefault(tuple(w[at : at + 50]), i)
    for i, t in single.items():
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for at in range(len(w) - 49):
            if first[tuple(w[at : at + 50])] < i:
                gone[at : at + 50] = [True] * 50
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (i not in passages) if w and not left else WORD.findall(passages[i] or "") == left

    # packing
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = made[4].collect()
    assert {(r.doc_id, r.length) for r in rows} == {(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in passages.items()}
    assert made[4].select("sequence_id").distinct().count() <= -(-sum(r.length for r in rows) // 2048) + 1


def test_repeated_rows_stay(spark):
    """A clean document that is given twice is neither lost nor multiplied by the stages before packing."""
    text = "\n".join(" ".join(f"w{k}x{j}" for j in range(30)) for k in range(3))
    docs = spark.createDataFrame([(5, text, "en", "s", len(text))] * 2 + [(8, "other words", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    for stage in (corpus_pipeline.line_stage, corpus_pipeline.ngram_stage, corpus_pipeline.substring_stage):
        docs = stage(spark, docs, "")
        assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()) == [(5, text, "en", "s", len(text))] * 2 + [(8, "other words", "en", "s", 11)]


def test_run_gives_the_last_stage(spark, tmp_path):
    make(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50
