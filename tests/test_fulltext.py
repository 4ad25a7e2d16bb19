import random
import re

from pyspark.sql import functions as F

from scholarmill.functions.stems import EXCEPTIONS, SETTLED, STOP_WORDS, with_stems
from scholarmill.operators import fulltext


def test_stems_of_the_published_rules(spark):
    known = {
        "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist", "consolation": "consol", "consolatory": "consolatori", "consoling": "consol",
        "knack": "knack", "knives": "knive", "knights": "knight", "knightly": "knight", "kneaded": "knead", "knitting": "knit", "running": "run", "hopping": "hop", "hoping": "hope", "cries": "cri", "cry": "cri", "by": "by", "say": "say", "ties": "tie", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi",
        "generate": "generat", "generally": "general", "communism": "communism", "arsenal": "arsenal", "relational": "relat", "conditional": "condit", "rationalize": "ration", "luxuriated": "luxuri", "falling": "fall", "probate": "probat", "controll": "control", "adoption": "adopt", "nation": "nation",
        "bed": "bed", "shed": "shed", "shred": "shred", "agreed": "agre", "feed": "feed", "abundantly": "abund", "geology": "geolog", "geologi": "geolog", "youth": "youth", "boyish": "boyish", "enjoyment": "enjoy", "sky": "sky", "inning": "inning", "innings": "inning", "proceeds": "proceed", "skies": "sky", "yes": "yes", "hopeful": "hope", "goodness": "good", "active": "activ", "creative": "creativ", "sensibiliti": "sensibl", "été": "été", "a": "a", "12": "12",
    }
    rows = spark.createDataFrame([(w, 1) for w in [*known, None]], "word string, stem_id int")
    got = {r.word: r.stem for r in with_stems(rows).collect()}
    assert got == {**known, None: None}
    assert set(with_stems(rows).columns) == {"word", "stem_id", "stem"}
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) and not set(STOP_WORDS) & {*EXCEPTIONS, *SETTLED} - {"only"}


def plain_rank(words, terms, stem):
    marks = [(p, {k for k, t in enumerate(terms) if stem[w].startswith(t)}) for p, w in enumerate(words) if w not in STOP_WORDS]
    marks = [(p, m) for p, m in marks if m]
    rank, covers = 0.0, 0
    for i in range(len(marks)):
        for j in range(i, len(marks)):
            has = set().union(*(m for _, m in marks[i : j + 1]))
            inner = j > i and any(len(set().union(*(m for _, m in part))) == len(terms) for part in (marks[i + 1 : j + 1], marks[i:j]))
            if len(has) == len(terms) and not inner:
                covers += 1
                rank += 0.1 / (1 + marks[j][0] - marks[i][0] - (j - i))
    return (covers, round(rank, 9)) if covers else None


def test_rank_is_that_of_the_shortest_covers(spark):
    rng = random.Random(1)
    words = ["running", "runs", "run", "jump", "jumping", "jumps", "the", "of", "other", "été", "12", "runner"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, "", "The of", "run"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id long, text string, place int").repartition(3)
    index = fulltext.build_index(docs, "id", "text")
    stem = {r.word: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    for query in ("running jumps", "runner run the", "jumping", "run jump OTHER", "12 run", "zzz run"):
        terms = fulltext.query_terms(spark, query)
        got = {r.id: (r.covers, round(r["rank"], 9)) for r in fulltext.ranked(index, terms).collect()}
        want = {k: plain_rank(re.findall(r"\w+", (t or "").lower()), terms, stem) for k, t in enumerate(texts)}
        assert got == {k: v for k, v in want.items() if v}
    assert fulltext.query_terms(spark, "the of") == []
    assert fulltext.ranked(index, []).count() == 0


def test_a_search_reads_only_the_parts_of_the_index_that_hold_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"{chr(97 + j)}word{k % 7}" for j in range(26))) for k in range(200)], "id long, text string")
    fulltext.build_index(docs, "id", "text", path=str(tmp_path / "index"))
    index = fulltext.open_index(spark, str(tmp_path / "index"))
    found = fulltext.postings(index, ["cword3", "xword1"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "StringStartsWith(term,cword3)" in plan and "StringStartsWith(term,xword1)" in plan
    files = {r.f for r in found.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files and all("head=c" in f or "head=x" in f for f in files)
    assert {"head=c", "head=x"} == {re.search("head=.", f).group() for f in files}


def test_a_page_of_matches_with_the_total(spark):
    docs = spark.createDataFrame([(k, "alpha " * (k % 5 + 1) + "beta", k % 3) for k in range(40)] + [(100, "alpha", 1)], "id long, text string, year int")
    index = fulltext.build_index(docs, "id", "text")
    rows = fulltext.search_page(index, docs, "id", "alpha beta", [F.desc("year"), F.col("id")], number=2, size=15).collect()
    assert [r.id for r in rows] == sorted(range(40), key=lambda k: (-(k % 3), k))[15:30] and {r.total for r in rows} == {40}
    assert fulltext.search_page(index, docs, "id", "gamma", [F.col("id")]).count() == 0


def test_index_entries_are_shuffled_for_stems_and_ranges_alone(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(fulltext, "written", lambda df, name, keep=fulltext.written: (written.setdefault(name, df), keep(df, name))[1])
    rows = [(1, "Studies of the study"), (2, "a study; STUDY"), (1, "studied rice"), (3, None), (4, "of the 007 1s")]
    index = fulltext.build_index(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text")
    assert "Exchange hash" not in written["postings"]._jdf.queryExecution().executedPlan().toString()
    got = [(r.term, r.id, list(r.places)) for r in index.collect()]
    assert sorted(got) == [("007", 4, [2]), ("1s", 4, [3]), ("rice", 1, [1]), ("studi", 1, [0, 0, 3]), ("studi", 2, [1, 2])]
