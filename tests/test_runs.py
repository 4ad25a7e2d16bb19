import pytest
from pyspark.sql import functions as F

from scholarmill.streaming import reviews, runs


def fetch_of(spark, calls):
    def fetch(run_id, window):
        calls.append(run_id)
        rows = [(k, f"2024-01-{k % 20 + 1:02d}", k * 10) for k in range(60)]
        return spark.createDataFrame(rows, "id long, day string, v long").where(F.col("day").between(window.from_date, window.to_date))

    return fetch


class Killed(BaseException):
    """What no handler of a run sees: the process is gone."""


def test_a_run_that_is_killed_midway_gives_the_same_tables_from_the_next(spark, tmp_path):
    calls, done = [], []

    def double(rows):
        done.append("double")
        return rows.withColumn("v", F.col("v") * 2)

    def steady(rows):
        return rows.withColumn("w", F.col("v") + 1)

    def trouble(kind):
        def stage(rows):
            raise kind("gone")

        return stage

    def run(made, to_date, last):
        return made.run(to_date, fetch_of(spark, calls), [("double", double), ("last", last)], "id")

    plain = runs.Runs(spark, str(tmp_path / "plain"), "k", "2024-01-01")
    made = runs.Runs(spark, str(tmp_path / "killed"), "k", "2024-01-01")
    assert made.checkpoint() is None and made.table() is None
    for r in (plain, made):
        assert run(r, "2024-01-05", steady) == "succeeded"
    before = sorted(map(tuple, made.table().collect()))
    calls.clear(), done.clear()
    for kind in (Killed, ValueError):
        with pytest.raises(kind):
            run(made, "2024-01-12", trouble(kind))
        assert made.checkpoint() == "2024-01-05" and sorted(map(tuple, made.table().collect())) == before
    assert run(made, "2024-01-12", steady) == "succeeded"
    assert len(set(calls)) == 1  # one id for the same days
    assert run(plain, "2024-01-12", steady) == "succeeded"
    assert sorted(map(tuple, made.table().collect())) == sorted(map(tuple, plain.table().collect()))
    assert made.checkpoint() == "2024-01-12" and run(made, "2024-01-12", steady) == "nothing"
    log = [(r.number, r.status, r.from_date, r.to_date) for r in made.log().orderBy("number").collect()]
    assert log == [(1, "succeeded", "2024-01-01", "2024-01-05"), (2, "failed", "2024-01-06", "2024-01-12"), (3, "succeeded", "2024-01-06", "2024-01-12")]
    # earlier days again: the table takes them, the checkpoint stays
    assert made.run("2024-01-03", fetch_of(spark, calls), [("last", steady)], "id", explicit="2024-01-01") == "succeeded"
    assert made.checkpoint() == "2024-01-12" and made.table().count() == 36
    assert runs.Runs(spark, str(tmp_path / "killed"), "other", "2024-01-01").checkpoint() is None


def test_finished_stages_are_not_done_again(spark, tmp_path):
    made = runs.Runs(spark, str(tmp_path / "r"), "k", "2024-01-01")
    store = made.store
    first = store.keep(spark.range(3), "work/x")
    again = store.keep(spark.range(9), "work/x")
    assert first.count() == again.count() == 3
    assert store.put("log/a.json", "{}") and not store.put("log/a.json", "other")
    assert spark.read.text(str(tmp_path / "r/log/a.json")).first().value == "{}"


def test_collection_goes_on_from_the_last_cursor(spark, tmp_path):
    made = runs.Runs(spark, str(tmp_path / "r"), "k", "2024-01-01")
    asked = []

    def pages(stop):
        def walk(cursor):
            at = int(cursor or 0)
            while True:
                if at == stop:
                    raise ConnectionError("cut off")
                asked.append(at)
                yield spark.createDataFrame([(at * 10 + j,) for j in range(3)], "id long"), str(at + 1) if at < 4 else None
                at += 1

        return walk

    with pytest.raises(ConnectionError):
        made.collected("x", pages(2))
    got = made.collected("x", pages(None))
    assert sorted(r.id for r in got.collect()) == [k * 10 + j for k in range(5) for j in range(3)]
    assert asked == [0, 1, 2, 3, 4]
    made.collected("x", pages(0))  # complete: nothing is asked
    assert asked == [0, 1, 2, 3, 4]
    assert [(r.page, r.records, r.next) for r in made.pages_report("x").orderBy("page").collect()] == [(k, 3, str(k + 1) if k < 4 else None) for k in range(5)]


def test_reviews(spark):
    records = spark.createDataFrame([(1, True, "AI"), (2, False, "NON_AI"), (3, None, None)], "record long, verified boolean, model_label string")
    A, R = reviews.ACCEPTED, reviews.REJECTED
    rows = [
        (1, 1, "k1", "decide", R, "x", "no", 0), (1, 2, "k1", "decide", R, "x", "no", 0), (1, 3, None, "decide", A, "x", None, 0), (1, 4, None, "decide", A, "x", None, 1), (1, 5, None, "reopen", None, "x", None, 1),
        (1, 6, None, "assign", None, "y", None, 2), (1, 7, None, "decide", A, "x", None, 3), (1, 8, None, "decide", A, "Y", None, 3), (1, 9, "k9", "decide", R, "y", " ", 4), (1, 10, "k9", "decide", R, "y", "ok", 4),
        (2, 11, None, "decide", A, "x", None, 0), (2, 12, None, "reopen", None, "x", None, 0), (9, 13, None, "decide", A, "x", None, 0), (2, 14, None, "decide", "maybe", "x", None, 0),
    ]
    events = spark.createDataFrame(rows, "record long, seq long, key string, event string, decision string, actor string, notes string, expected_version long").repartition(3)
    log = {r.seq: (r.outcome, r.status, r.version) for r in reviews.replay(records, events).collect()}
    assert [log[k][0] for k in sorted(log)] == ["applied", "repeated", "stale", "already_decided", "applied", "applied", "forbidden", "applied", "reason_required", "repeated", "ownership_not_verified", "not_decided", "not_found", "invalid"]
    assert log[1] == ("applied", R, 1) and log[8] == ("applied", A, 4)
    got = {r.record: tuple(r)[1:] for r in reviews.states(records, reviews.replay(records, events)).collect()}
    assert got == {1: (A, 4, "y", False, 4, 4), 2: ("pending_review", 0, None, False, 0, 3), 3: ("pending_review", 0, None, False, 0, 0)}
    assert reviews.replay(records, events.limit(0)).count() == 0
