"""Streams cut into batches in any way, and sinks when a batch is tried again."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from assayer.operators import logs, scoring
from assayer.streaming import sessions as S

IDS = "id string, content string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_a_batch_tried_twice_is_kept_once(spark, tmp_path):
    sink = S.kept(str(tmp_path / "t"), "r1")
    for number, values in ((0, "ab"), (0, "ab"), (1, "c"), (1, "c")):
        sink(spark.createDataFrame([(v,) for v in values], "v string"), number)
    S.kept(str(tmp_path / "t"), "r2")(spark.createDataFrame([("d",)], "v string"), 0)
    assert rows(S.stored(spark, str(tmp_path / "t")), "v") == [("a",), ("b",), ("c",), ("d",)]


def test_admission_tried_again_after_half_of_it(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    batch = spark.createDataFrame([(1, '{"a":1}'), (2, '{"b":1}'), (3, "no json")], "k long, body string")
    S.written(batch.limit(1), bad, "r", 0)  # what a try that died has left
    sink = S.admission("k", "body", ["a"], ["id"], good, bad, "r")
    for _ in range(2):
        sink(batch, 0)
    assert rows(S.stored(spark, good), "k") == [(1,)]
    assert rows(S.stored(spark, bad), "k") == [(2,), (3,)]


def batched(spark, folder, schema, batches):
    """A stream of files, one a batch, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/b{i:03d}")
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def test_publication_by_state(spark, tmp_path):
    """Conflicts inside a batch, across batches and with what was there before; a further run and a retried batch add nothing."""
    path, conflicts, check, source = (str(tmp_path / x) for x in ("p", "c", "k", "in"))
    first = [("1", "x"), ("1", "x"), ("1", "y"), ("2", None), ("2", "b"), ("3", "q"), ("9", "old")]
    again = [("1", "x"), ("1", "z"), ("2", "n"), ("4", "w"), ("9", "new")]
    known = spark.createDataFrame([("9", "old"), ("8", None)], IDS)
    stream = batched(spark, source, IDS, [first, again])
    for _ in range(2):
        S.published(stream, path, conflicts, check, known)
    assert rows(S.stored(spark, path).fillna("-"), "id", "content") == [("1", "x"), ("2", "-"), ("3", "q"), ("4", "w")]
    want = [("1", "y"), ("1", "z"), ("2", "b"), ("2", "n"), ("9", "new")]
    assert rows(S.stored(spark, conflicts), "id", "content") == want
    spark.createDataFrame([("4", "w"), ("5", "v"), ("8", "x")], IDS).coalesce(1).write.parquet(f"{source}/b900")
    S.published(stream, path, conflicts, check, None)
    assert rows(S.stored(spark, path).fillna("-"), "id", "content") == [("1", "x"), ("2", "-"), ("3", "q"), ("4", "w"), ("5", "v")]
    assert rows(S.stored(spark, conflicts), "id", "content") == sorted([*want, ("8", "x")])


def test_ids_share_calls_of_the_publication(spark, tmp_path, monkeypatch):
    """Ids of a group meet in one call, with a state row each; an id may be null."""
    monkeypatch.setattr(S, "GROUPS", 2, raising=False)
    seen, taken = str(tmp_path / "seen"), S.Once.handleInputRows

    def counted(self, key, batches, timers):
        with open(seen, "a") as f:
            f.write("x")
        yield from taken(self, key, batches, timers)

    monkeypatch.setattr(S.Once, "handleInputRows", counted)
    path, conflicts = str(tmp_path / "p"), str(tmp_path / "c")
    sent = [(str(i), c) for i in range(30) for c in ("b", "a")] + [(None, "n")]
    S.published(batched(spark, str(tmp_path / "in"), IDS, [sent]), path, conflicts, str(tmp_path / "k"))
    assert rows(S.stored(spark, path).fillna("-"), "id", "content") == sorted([*((str(i), "a") for i in range(30)), ("-", "n")])
    assert rows(S.stored(spark, conflicts), "id", "content") == sorted((str(i), "b") for i in range(30))
    assert len(open(seen).read()) <= 2


CALLS = "session_id long, seq long, at timestamp, key string, finishes boolean"


def calls(seed, sessions=25):
    rng = random.Random(seed)
    at = lambda n: datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=n)
    return [(s, i, at(i * 10 + s), None if rng.random() < 0.2 else rng.choice("ab"), rng.random() < 0.2) for s in range(sessions) for i in range(rng.randint(1, 15))]


@pytest.mark.parametrize("batches", [1, 6])
def test_retries_in_any_order_of_arrival(spark, tmp_path, batches):
    """Calls arrive up to 200 seconds out of order; a last call, far on, lets the others pass."""
    rng = random.Random(batches)
    sent = sorted(calls(1), key=lambda c: c[2].timestamp() + rng.uniform(0, 190))
    size = -(-len(sent) // batches)
    end = (999, 0, datetime.datetime(2024, 5, 2), None, False)
    stream = batched(spark, str(tmp_path / "in"), CALLS, [*(sent[i * size : (i + 1) * size] for i in range(batches)), [end]])
    S.drained(S.retries(stream, delay_ms=200_000), S.kept(str(tmp_path / "out"), "r"))
    twin = logs.retries(spark.createDataFrame(sent, CALLS))
    got = S.stored(spark, str(tmp_path / "out")).filter("session_id <> 999")
    assert rows(got, "session_id", "seq", "answer") == rows(twin, "session_id", "seq", "answer")


def test_a_call_after_the_watermark_is_answered_late(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=n)
    first = [(1, 5, at(50), "a", False), (2, 1, at(1000), None, False)]
    second = [(1, 4, at(40), "b", True), (1, 6, at(990), "b", False), (3, 1, at(995), "z", True)]
    third = [(4, 1, at(5000), None, False)]
    fourth = [(3, 2, at(4999), "z", False), (1, 3, at(6000), "a", False), (5, 1, at(9000), None, False)]
    stream = batched(spark, str(tmp_path / "in"), CALLS, [first, second, third, fourth, [(6, 1, at(20000), None, False)]])
    S.drained(S.retries(stream, delay_ms=100_000), S.kept(str(tmp_path / "out"), "r"))
    got = rows(S.stored(spark, str(tmp_path / "out")).filter("session_id < 4"), "session_id", "seq", "answer")
    # Session 1: 5 passed with the first mark; 4 comes after it; 3 is in time but its turn has passed.
    assert got == [(1, 3, "LATE"), (1, 4, "LATE"), (1, 5, "proceed"), (1, 6, "busy"), (2, 1, "proceed"), (3, 1, "proceed"), (3, 2, "replay")]


def test_lifecycle_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(8)
    sent = [(s, i, at, rng.choice(logs.ACTIONS)) for s, i, at, _, _ in calls(3)]
    rng.shuffle(sent)
    schema = "session_id long, seq long, at timestamp, action string"
    stream = batched(spark, str(tmp_path / "in"), schema, [sent[0::3], sent[1::3], sent[2::3], [(999, 0, datetime.datetime(2024, 5, 2), "start")]])
    S.drained(S.lifecycle(stream, delay_ms=1_000_000), S.kept(str(tmp_path / "out"), "r"))
    twin = logs.session_answers(spark.createDataFrame(sent, schema))
    columns = ("session_id", "seq", "action", "state", "answer")
    assert rows(S.stored(spark, str(tmp_path / "out")).filter("session_id <> 999"), *columns) == rows(twin, *columns)


def test_sessions_share_state_rows(spark, tmp_path, monkeypatch):
    """State rows and calls of the fold are as many as groups, not sessions; the last call is answered though nothing comes after it."""
    monkeypatch.setattr(S, "GROUPS", 8, raising=False)
    at = lambda n: datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=n)
    sent = [(s, i, at(10 * s + i), action) for s in range(60) for i, action in enumerate(["start", "finalize", "close"])] + [(1000, 0, at(5000), "start")]
    schema, check = "session_id long, seq long, at timestamp, action string", str(tmp_path / "check")
    S.drained(S.lifecycle(batched(spark, str(tmp_path / "in"), schema, [sent])), S.kept(str(tmp_path / "out"), "r"), checkpoint=check)
    columns = ("session_id", "seq", "action", "state", "answer")
    assert rows(S.stored(spark, str(tmp_path / "out")), *columns) == rows(logs.session_answers(spark.createDataFrame(sent, schema)), *columns)
    assert spark.read.format("statestore").load(check).count() <= 8


def test_retries_share_state_rows(spark, tmp_path, monkeypatch):
    """Sessions of a group keep their own owners while they wait in one row of state."""
    monkeypatch.setattr(S, "GROUPS", 4, raising=False)
    sent, check = calls(11, sessions=40), str(tmp_path / "check")
    S.drained(S.retries(batched(spark, str(tmp_path / "in"), CALLS, [sent])), S.kept(str(tmp_path / "out"), "r"), checkpoint=check)
    assert rows(S.stored(spark, str(tmp_path / "out")), "session_id", "seq", "answer") == rows(logs.retries(spark.createDataFrame(sent, CALLS)), "session_id", "seq", "answer")
    assert spark.read.format("statestore").load(check).count() <= 4


def test_waiting_calls_are_packed(spark, tmp_path, monkeypatch):
    """A call that waits costs the state some bytes, not its text, and so does the session that it waits in."""
    monkeypatch.setattr(S, "GROUPS", 4, raising=False)
    sent, check = calls(12, sessions=600), str(tmp_path / "check")
    S.drained(S.retries(batched(spark, str(tmp_path / "in"), CALLS, [sent]), delay_ms=1_000_000_000), S.kept(str(tmp_path / "out"), "r"), checkpoint=check)
    held = spark.read.format("statestore").load(check).select("value.groupState.*").collect()
    assert 0 < sum(len(v) for row in held for v in row) < 20 * len(sent)


def test_waiting_calls_come_back_whole(spark, tmp_path, monkeypatch):
    """Nulls, numbers that no double holds, and calls of one number and time, which go by their items' text."""
    monkeypatch.setattr(S, "GROUPS", 2, raising=False)
    at = lambda n: datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=n)
    big = 2**60 + 1
    first = [(big, 6, at(3), None, False), (big, 6, at(3), "a", True), (None, big + 1, at(2), "b", True), (big + 1, 1, at(9), None, True)]
    second = [(None, big, at(1), "a", False), (big, 5, at(3), None, None), (big + 1, 2, at(9), "é", None), (big, 7, at(8), "a", None)]
    stream = batched(spark, str(tmp_path / "in"), CALLS, [first, second, [(7, 0, at(5000), None, False)]])
    S.drained(S.retries(stream, delay_ms=100_000), S.kept(str(tmp_path / "out"), "r"))
    got = rows(S.stored(spark, str(tmp_path / "out")).filter("session_id is distinct from 7").fillna(-1, "session_id"), "session_id", "seq", "answer")
    want = [(-1, big, "proceed"), (-1, big + 1, "busy"), (big, 5, "proceed"), (big, 6, "finished"), (big, 6, "proceed"), (big, 7, "replay"), (big + 1, 1, "proceed"), (big + 1, 2, "replay")]
    assert got == want


def test_update_mode_writes_what_changed(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "split long, status string, reward long"
    batches = [[(k, "ok", k) for k in range(40)], [(3, "error", None)], [(3, "ok", 5), (50, "invalid", None)], [(4, "ok", 1)], [(50, "ok", 2)]]
    run = "r"
    sink = S.upserts(path, ["split"], run, compact=2)

    def twice(batch, number):
        batch = batch.persist()
        sink(batch, number)
        sink(batch, number)

    S.drained(S.running_totals(batched(spark, str(tmp_path / "in"), schema, batches), "split"), twice, "update")
    twin = scoring.totals(spark.createDataFrame([r for b in batches for r in b], schema), "split")
    columns = twin.columns
    assert rows(S.latest(spark, path, ["split"], run), *columns) == rows(twin, *columns)
    sizes = {r.batch: r.n for r in S.stored(spark, f"{path}/changes").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 40, 1: 1, 2: 2, 3: 1, 4: 1}
    assert {r.batch for r in S.stored(spark, f"{path}/base").select("batch").distinct().collect()} == {2, 4}


def test_session_answers_equal_a_fold(spark):
    rng = random.Random(5)
    names = ["start", "finalize", "finalized", "finalize_failed", "close"]
    rows = [(s, i, rng.choices(names, [3, 3, 2, 1, 2])[0]) for s in range(120) for i in range(rng.randrange(1, 12))]
    want = []
    for s in range(120):
        state = "none"
        for _, i, action in [r for r in rows if r[0] == s]:
            answer, then = logs.session_step(state, action)
            want.append((s, i, action, state, answer))
            state = then
    got = logs.session_answers(spark.createDataFrame(rows, "session_id long, seq long, action string"))
    assert rows_of(got) == sorted(want)
    assert {a for *_, a in want} == {"accepted", "nothing", "SESSION_UNKNOWN", "SESSION_BUSY", "SESSION_STATE"}


def rows_of(df):
    return sorted(tuple(r) for r in df.select("session_id", "seq", "action", "state", "answer").collect())
