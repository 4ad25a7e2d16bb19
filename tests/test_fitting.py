import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarmill.functions import payloads
from scholarmill.operators import calibrate, coherence
from scholarmill.operators.ordered import running
from scholarmill.registry import QUERIES


def plain_isotonic(scores, labels):
    xs = sorted(set(scores))
    groups = [[sum(y for s, y in zip(scores, labels, strict=True) if s == x), scores.count(x), [x]] for x in xs]
    out = []
    for g in groups:
        out.append(g)
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            b, a = out.pop(), out.pop()
            out.append([a[0] + b[0], a[1] + b[1], a[2] + b[2]])
    return {x: p / n for p, n, members in out for x in members}


@pytest.mark.parametrize("seed", [0, 1])
def test_isotonic_with_ties(spark, seed):
    rng = random.Random(seed)
    scores = [round(rng.random(), 1 if seed == 0 else 3) for _ in range(400)]
    labels = [int(rng.random() < s) for s in scores]
    rows = spark.createDataFrame([*zip(scores, labels, strict=True), (None, 1), (0.5, None)], "s double, y int").repartition(6)
    fitted = calibrate.Isotonic.of(calibrate.isotonic(calibrate.by_score(rows, "s", "y")))
    want = plain_isotonic(scores, labels)
    got = {r.s: r.c for r in rows.where("s IS NOT NULL").select("s", fitted.column(F.col("s")).alias("c")).collect()}
    assert all(got[x] == pytest.approx(v, abs=1e-12) for x, v in want.items())
    ends = spark.createDataFrame([(-1.0,), (9.0,), (None,)], "s double").select(fitted.column(F.col("s")).alias("c")).collect()
    assert [ends[0].c, ends[1].c, ends[2].c] == [pytest.approx(min(want.values())), pytest.approx(max(want.values())), None]


def test_sigmoid_is_where_the_gradient_is_zero(spark):
    rng = random.Random(5)
    scores = [round(rng.uniform(-3, 3), 2) for _ in range(500)]
    labels = [int(rng.random() < 1 / (1 + math.exp(-2 * s + 0.5))) for s in scores]
    rows = spark.createDataFrame(list(zip(scores, labels, strict=True)), "s double, y int")
    found = calibrate.sigmoid(calibrate.by_score(rows, "s", "y"))
    p = [1 / (1 + math.exp(-(s * found.slope + found.offset))) for s in scores]
    assert abs(sum((q - y) * s for q, y, s in zip(p, labels, scores, strict=True)) + found.slope) < 1e-6
    assert abs(sum(q - y for q, y in zip(p, labels, strict=True))) < 1e-6
    assert rows.select(found.column(F.col("s")).alias("c")).first().c == pytest.approx(p[0])
    apart = spark.createDataFrame([(0.0, 0)] * 5 + [(1.0, 1)] * 5, "s double, y int")  # separable: the penalty holds the slope
    assert 0 < calibrate.sigmoid(calibrate.by_score(apart, "s", "y")).slope < 10


@pytest.mark.parametrize("labels", [[0, 0], [1, 1], []])
def test_one_label_is_refused(spark, labels):
    rows = spark.createDataFrame([(0.5, y) for y in labels], "s double, y int")
    for fit in (calibrate.isotonic, calibrate.sigmoid):
        with pytest.raises(ValueError):
            fit(calibrate.by_score(rows, "s", "y"))


def test_metrics_count_ties_half(spark):
    rows = [(0.2, 0), (0.5, 1), (0.5, 0), (0.9, 1), (1.4, 1), (-0.3, 0)]
    got = calibrate.metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for a, y in rows for b, z in rows if y and not z]
    assert got.roc_auc == pytest.approx(sum(pairs) / len(pairs)) and (got.records, got.positives, got.negatives) == (6, 3, 3)
    assert got.brier_score == pytest.approx((0.04 + 0.25 + 0.25 + 0.01) / 6)
    assert calibrate.metrics(spark.createDataFrame([(0.2, 0)], "s double, y int"), "s", "y").first().roc_auc is None


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), k, rng.randrange(9)) for k in range(300)]
    got = {(r.a, r.k): r.s for r in running(spark.createDataFrame(rows, "a int, k int, v int").repartition(5), ["a", "k"], {"s": "v"}).collect()}
    total = 0
    for a, k, v in sorted(rows):
        total += v
        assert got[a, k] == total


def plain_coherence(docs, topic, window):
    spans = [set(d[i : i + window]) for d in docs for i in range(max(len(d) - window, 0) + 1) if d]
    n = len(spans)
    p = lambda *w: sum(all(x in s for x in w) for s in spans) / n
    known = [w for w in topic if p(w) > 0]
    vectors = {a: np.array([math.log((p(a, b) + 1e-12) / (p(a) * p(b))) / -math.log(p(a, b) + 1e-12) if a in known and b in known else 0.0 for b in topic]) for a in topic}
    together = sum(vectors.values())
    cosine = [v @ together / (np.linalg.norm(v) * np.linalg.norm(together)) if v.any() and together.any() else 0.0 for v in vectors.values()]
    return float(np.mean(cosine))


def test_coherence_of_ten_topics(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    docs = [[rng.choice(words[: rng.choice([5, 10, 30])]) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    topics = {t: rng.sample(words, 5) + (["unseen"] if t == 3 else []) for t in range(10)}
    table = spark.createDataFrame([(d,) for d in docs] + [(None,)], "tokens array<string>").repartition(3)
    listed = spark.createDataFrame([(t, w) for t, ws in topics.items() for w in ws] + [(0, topics[0][0])], "topic long, word string")
    for window in (4, 110):
        got = {r.topic: r.coherence for r in coherence.coherence_cv(table, "tokens", listed, window).collect()}
        for t, ws in topics.items():
            assert got[t] == pytest.approx(plain_coherence(docs, ws, window), abs=1e-6)
    sets = [set(w) for w in topics.values()]
    shares = [len(a & b) / len(a | b) for k, a in enumerate(sets) for b in sets[k + 1 :]]
    assert coherence.redundancy(listed).first().redundancy == pytest.approx(np.mean(shares))
    assert coherence.redundancy(listed.where("topic = 1")).first().redundancy == 0
    assert coherence.diversity(listed.limit(0)).first().diversity == 0


def plain_split(text):
    out, start, depth, inside, skip = [], 0, 0, False, False
    for i, c in enumerate(text or ""):
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth = max(0, depth - 1)
        elif c == ";" and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, (text or "")[start:]] if x.strip()]


def plain_items(text):
    items, at, depth, quoted, k = [], 0, 0, False, 0
    while k < len(text):
        c = text[k]
        if quoted and c == "\\":
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "[{":
            depth += 1
        elif not quoted and c in "]}":
            depth = max(0, depth - 1)
        elif not quoted and c == ";" and not depth:
            items.append(text[at:k])
            at = k + 1
        k += 1
    return [x.strip() for x in [*items, text[at:]] if x.strip()]


def test_any_payload_is_split_as_letter_by_letter(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice('[]{};;"\\a b') for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.items for r in rows.select("id", payloads.split_payload(F.col("t")).alias("items")).collect()}
    assert [got[k] for k in range(len(texts))] == [plain_items(t) for t in texts]


def test_a_long_payload_takes_time_in_proportion(spark):
    """4,000 references in one text: each item is cut from pieces that are found once."""
    item = '{"DOI": "10.1/A", "author": {"name": ["x; y"]}, "title": "t ; u"}'
    rows = spark.createDataFrame([(1, " ; ".join([item] * 4000))], "id long, t string").repartition(1)
    began = time.time()
    got = payloads.reference_rows(rows, "id", "t").collect()
    assert time.time() - began < 25
    assert {(r.reference_doi, r.reference_title, r.reference_author, r.raw_reference_json) for r in got} == {("10.1/a", "t ; u", '{"name":["x; y"]}', item)}
    assert sorted(r.reference_index for r in got) == list(range(1, 4001))


def test_texts_from_their_index_need_no_shuffle(spark, tmp_path):
    texts = ["a b a c b a", "", "  ", None, "one", "x  y\n z", " ".join(f"w{k % 700}" for k in range(9000))]
    rows = [(k // 2, t) for k, t in enumerate(texts)]  # ids come twice
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["inverted_index_text"](spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = [(k, t if t is None else " ".join(w for w in t.split(" ") if w)) for k, t in rows]
    assert sorted(df.collect(), key=repr) == sorted(want, key=repr)
    index = spark.createDataFrame([("b a b",)], "t string").select(payloads.inverted_index(F.split("t", " "))).first()[0]
    assert [tuple(x) for x in index] == [("a", [1]), ("b", [0, 2])]


def test_payloads_are_split_outside_of_strings_and_brackets(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice('ab;;"\\{}[] \n') for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, "", " ; ", '{"a":"b;c\\";"};x', '"open ; string', "]];a;[;]", '{"t":"' + "y;" * 20000 + '"};z']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.items for r in rows.select("id", payloads.split_payload(F.col("t")).alias("items")).collect()}
    assert got == {k: plain_split(t) for k, t in enumerate(texts)}


def test_works_are_flat_and_lists_aligned(spark):
    work = {
        "id": "https://openalex.org/W7", "doi": "https://doi.org/10.1/X", "display_name": "T", "title": None, "publication_year": 2020, "unknown": {"x": 1},
        "authorships": [
            {"author": {"display_name": "A"}, "is_corresponding": True, "institutions": [{"display_name": "I1", "country_code": "lk"}, {"display_name": "I2", "country_code": "US"}], "raw_affiliation_strings": ["r1", "r1"]},
            {"author": {"display_name": None}, "institutions": []}, {"author": {"display_name": "B"}, "countries": ["GB"]},
        ],
        "topics": [{"display_name": "t1", "field": {"display_name": "f1"}}, {"display_name": "t2"}, {"display_name": "t1"}], "locations": [{"license": "cc", "source": {"display_name": "S"}}, {"license": "cc"}], "grants": [{"funder_display_name": "F", "award_id": "9"}], "referenced_works": ["a", "b"],
    }
    rows = spark.createDataFrame([(1, json.dumps(work)), (2, "{}"), (3, "no json"), (4, None)], "k long, w string")
    got = {r.k: r for r in payloads.flat_works(rows, "w").collect()}
    r = got[1]
    assert (r.work_id, r.doi, r.title, r.author_count, r.authors, r.home_authors, r.institutions, r.home_institutions, r.countries) == ("W7", "10.1/x", "T", 3, "A; B", "A", "I1; I2", "I1", "LK; US; GB")
    assert (r.author_list, r.author_institutions, r.author_countries) == ("A; ; B", "I1, I2; ; ", "LK, US; ; GB")
    assert (r.first_author_name, r.first_author_institution, r.last_author_name, r.corresponding_author_name, r.corresponding_author_countries) == ("A", "I1; I2", "B", "A", "LK; US")
    assert (r.has_home_author, r.has_foreign_author, r.topics, r.primary_topic, r.primary_field, r.funder, r.grant_award) == (True, True, "t1; t2", "t1", "f1", "F", "9")
    assert (r.locations_count, r.location_licenses, r.location_sources, r.referenced_works_count, r.is_retracted, r.raw_affiliation_strings) == (2, "cc", "S", 2, False, "r1")
    for k in (2, 3, 4):
        assert (got[k].authors, got[k].author_count, got[k].topics, got[k].has_home_author, got[k].locations_count, got[k].title) == ("", 0, "", False, 0, None)
