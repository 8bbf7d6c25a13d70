"""Sessions that hold a third of all rows, against a fold in one place."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import logs, ranges


def long_sessions(seed):
    """(session, seq) with one session of a third of all rows, one of a tenth, and many small ones; seq is no running number."""
    rng = random.Random(seed)
    sizes = {7: 3000, 8: 900, None: 300} | {s: rng.randint(1, 12) for s in range(100, 600)}
    return {s: sorted(rng.sample(range(10 * n), n)) for s, n in sizes.items()}


def test_session_answers(spark):
    rng = random.Random(2)
    rows, want = [], []
    for s, seqs in long_sessions(1).items():
        state = "none"
        for seq in seqs:
            action = rng.choice(["start", "finalize", "finalized", "finalize_failed", "close", "start", "other", None][: 8 if rng.random() < 0.02 else 5]) if len(seqs) < 100 or rng.random() < 0.002 else rng.choice(["start", "finalized"])
            answer, then = logs.session_step(state, action) if action in logs.ACTIONS else (None, state)
            rows.append((s, seq, action, "x"))
            want.append((s, seq, action, "x", state, answer))
            state = then
    rng.shuffle(rows)
    got = logs.session_answers(spark.createDataFrame(rows, "session_id long, seq long, action string, note string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    parts = ranges.dealt(spark.createDataFrame(rows, "session_id long, seq long, action string, note string"), "session_id", ["seq"]).filter("session_id = 7").select(F.spark_partition_id()).distinct().count()
    assert parts > 1
    assert logs.session_answers(spark.createDataFrame([], "session_id long, seq long, action string")).count() == 0


@pytest.mark.parametrize("wide", [500, 1_000_000])
def test_retries(spark, monkeypatch, wide):
    monkeypatch.setattr(logs, "WIDE", wide)
    rng = random.Random(3)
    rows, want = [], []
    for s, seqs in long_sessions(4).items():
        owner, finished = None, False
        none, ends = rng.choice([0.1, 0.9, 1.0]), rng.choice([0, 1 / len(seqs), 0.3])
        for seq in seqs:
            key, finishes = None if rng.random() < none else rng.choice("abc"), rng.random() < ends
            owner = owner if owner is not None else key
            mine = owner is None or key == owner
            answer = ("replay" if key is not None and key == owner else "finished") if finished else "proceed" if mine else "busy"
            finished = finished or (mine and finishes)
            rows.append((s, seq, key, finishes))
            want.append((s, seq, key, finishes, answer))
    rng.shuffle(rows)
    got = logs.retries(spark.createDataFrame(rows, "session_id long, seq long, key string, finishes boolean"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_illegal_transitions(spark):
    rng = random.Random(5)
    rows = [(s, seq, rng.choice("uas")) for s, seqs in long_sessions(6).items() for seq in seqs]
    want, last = [], {}
    for s, seq, state in rows:
        if s in last and (last[s], state) not in {("u", "a"), ("a", "u")}:
            want.append((s, seq, last[s], state))
        last[s] = state
    rng.shuffle(rows)
    got = logs.illegal_transitions(spark.createDataFrame(rows, "k long, seq long, state string"), "k", "seq", "state", {("u", "a"), ("a", "u")})
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
