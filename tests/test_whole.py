"""Queries over all rows, against plain Python."""

import hashlib

from conftest import SMALL

from assayer.operators import fingerprint, matrix
from assayer.plans import catalog
from assayer.plans import views as V


def test_task_order_numbers_all_tasks(spark):
    tasks = sorted({r.task_key for r in V.cells(spark, SMALL).select("task_key").collect()})
    got = sorted((r.pos, r.task_key) for r in catalog.QUERIES["srt01_task_order"](spark, SMALL).collect())
    assert len(tasks) > 100 and got == list(enumerate(tasks, 1))


def test_numbered_with_gaps_and_empty(spark):
    keys = [-5, 0, 3, 1000, 7, 10**12, 8]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert sorted((r.pos, r.k) for r in matrix.numbered(df, "k").collect()) == list(enumerate(sorted(keys), 1))
    assert matrix.numbered(df.limit(0), "k").count() == 0


def test_places_in_groups_that_span_ranges(spark):
    rows = [(g, f"p{i:05d}") for g, n in (("a", 3), ("b", 2000), (None, 50), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows[::-1], "g string, path string")
    want = sorted((str(g), int(p[1:]) + 1, p) for g, p in rows)
    assert sorted((str(r.g), r.pos, r.path) for r in matrix.placed(df, ["g"], ["path"]).collect()) == want
    same = matrix.placed(spark.createDataFrame([(1, 5)] * 40, "g int, k int"), ["g"], ["k"])
    assert sorted(r.pos for r in same.collect()) == list(range(1, 41))


def test_tree_id_does_not_depend_on_how_rows_are_dealt_out(spark):
    df = spark.createDataFrame([("s", f"p{i}", str(i)) for i in range(500)], "s string, path string, hash string")
    ids = {tuple(fingerprint.tree_rolled_up(x, ["s"], "snap", ["path", "hash"], node=7).first()) for x in (df, df.repartition(9), df.orderBy("hash"))}
    other = fingerprint.tree_rolled_up(df.filter("path <> 'p77'"), ["s"], "snap", ["path", "hash"], node=7).first()
    assert len(ids) == 1 and other.n == 499 and other.id not in {i for _, i, _ in ids}


def test_identity_verdict_sees_every_file(spark):
    before = {(r.snapshot, r.path): r.text for r in V.files(spark, SMALL).collect()}
    after = {(r.snapshot, r.path): r.text for r in V.drifted(spark, SMALL).collect()}
    want = {}
    for s in {k[0] for k in before}:
        own = [k for k in before if k[0] == s]
        moved = sorted(k[1] for k in own if k in after and after[k] != before[k])
        want[s] = "error" if any(k not in after for k in own) else "fail" if moved else "pass", len(moved), moved[0] if moved else None
    got = {r.snapshot: (r.state, r.n_moved, r.first_moved) for r in catalog.QUERIES["agg15_identity_verdict"](spark, SMALL).collect()}
    assert {k: v for k, v in got.items() if v[0] != "not_applicable"} == want


def test_identity_verdict_without_pins(spark):
    pins = spark.createDataFrame([("a", "p", "1"), ("b", "p", "1"), ("c", "p", "1")], "s string, path string, before_id string")
    after = spark.createDataFrame([("a", "p", "1"), ("b", "p", "2")], "s string, path string, after_id string")
    subjects = spark.createDataFrame([(x,) for x in "abcdd"], "s string")
    got = sorted(tuple(r) for r in fingerprint.identity_verdicts(subjects, pins, after, "s").collect())
    assert got == [("a", "pass", 0, None), ("b", "fail", 1, "p"), ("c", "error", 0, None), ("d", "not_applicable", 0, None)]


def test_output_is_cut_in_bytes_in_every_file(spark):
    texts = {r.path: r.text.encode() for r in V.files(spark, SMALL).collect()}
    got = {r.path: (r["head"], r.truncated) for r in catalog.QUERIES["sca22_truncate_output"](spark, SMALL).collect()}
    assert got == {p: (hashlib.sha256(t[:100]).hexdigest(), len(t) > 100) for p, t in texts.items()}
    assert any(t[:100].decode(errors="replace").endswith("�") for t in texts.values())
