"""Laws of the operators on small literal tables."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.functions import identity
from assayer.operators import claims, closure, documents, films, fingerprint, logs, matrix, patches, runs, scoring
from assayer.sources import artifacts


def score(spark, states, tampered=False):
    rubric = spark.sql("""SELECT 'r' AS reward_id, array(named_struct('signal', 'a', 'weight', 60L), named_struct('signal', 'b', 'weight', 40L)) AS signals, array('a') AS required,
      array(named_struct('signal', 'b', 'state', 'fail', 'reward_max', 50L), named_struct('signal', 'a', 'state', 'fail', 'reward_max', 20L)) AS caps""")
    episodes = spark.createDataFrame([("r", tampered, states)], "reward_id string, tampered boolean, verification map<string,string>")
    row = scoring.score(episodes, rubric, "reward_id").first()
    return row.reward, row.status, row.validity


@pytest.mark.parametrize(("states", "tampered", "want"), [
    ({"a": "pass", "b": "pass"}, False, (100, "ok", "valid")),
    ({"a": "pass", "b": "fail"}, False, (50, "ok", "valid")),
    ({"a": "fail", "b": "fail"}, False, (0, "ok", "valid")),
    ({"a": "fail", "b": "pass"}, False, (20, "ok", "valid")),
    ({"a": "pass", "b": "not_applicable"}, False, (60, "ok", "valid")),
    ({"a": "not_applicable", "b": "pass"}, False, (None, "invalid", "invalid")),
    ({"a": "not_applicable", "b": "error"}, False, (None, "error", "invalid")),
    ({"a": "pass", "b": "pass", "c": "error"}, False, (None, "error", "invalid")),
    ({"a": "error", "b": "pass"}, True, (0, "invalid", "invalid")),
])
def test_score_precedence(spark, states, tampered, want):
    assert score(spark, states, tampered) == want


def test_missing_reward_is_not_zero(spark):
    rows = spark.createDataFrame([(None, 1), (0, 0), (2, 1), (1, 2)], "l int, r int")
    assert [x.r for x in rows.select(C.relation(F.col("l"), F.col("r")).alias("r")).collect()] == ["incomparable", "equal", "left_higher", "right_higher"]
    total = scoring.totals(spark.createDataFrame([("ok", 4), ("error", None)], "status string, reward int")).first()
    assert (total.scored, total.reward_sum, total.reward_mean) == (1, 4, 4.0)


def test_pairs_mirror_and_do_not_cross_tasks(spark):
    cells = spark.createDataFrame([(1, "c1", 10, "ok", 5), (1, "c2", 11, "ok", 7), (2, "c1", 12, "ok", 1)], "task_key int, candidate_key string, episode_key int, status string, reward int")
    rows = matrix.compared(matrix.pairs(cells)).collect()
    assert [(r.task_key, r.relation, r.right_minus_left) for r in rows] == [(1, "right_higher", 2)]


def test_ids_ignore_row_order(spark):
    rows = [("s", f"p{i}", f"h{i}") for i in range(20)]
    digest = lambda r, n=1: documents.map_digests(spark.createDataFrame(r, "s string, path string, hash string").repartition(n), ["s"], "path", "hash").first().digest
    ids = {digest(r, n) for r, n in ((rows, 1), (rows[::-1], 7))}
    changed = digest([*rows[:-1], ("s", "p19", "other")])
    assert len(ids) == 1 and changed not in ids


def test_paths(spark):
    cases = {"a/b": "a/b", "a//b/.": "a/b", "a\\b": "a/b", "/a": None, "C:/a": None, "a/../b": None, "": None, ".": None}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", C.safe_path(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in rows} == cases


def test_globs_cross_slashes(spark):
    rows = spark.createDataFrame([("a/b/c.txt",), ("c.txt",), ("x",)], "p string")
    assert [r.m for r in rows.select(C.matches_any(F.col("p"), ["*/c.txt"]).alias("m")).collect()] == [True, False, False]
    assert [r.m for r in rows.select(C.writable(F.col("p"), ["a/", "?"]).alias("m")).collect()] == [True, False, True]


def test_citations(spark):
    files = spark.createDataFrame([("f", "one\ntwo\nthree\n")], "path string, text string")
    cited = spark.createDataFrame([("f", 1, 2, "one\ntwo"), ("f", 1, 2, "one"), ("f", 3, 4, "x"), ("g", 1, 1, "x"), ("f", 0, 1, "one")], "path string, start_line int, end_line int, quote string")
    assert [r.outcome for r in claims.resolved(cited, files, ["path"]).orderBy("path", "start_line", "quote").collect()] == ["range", "mismatch", "pass", "range", "unknown"]
    outcomes = spark.createDataFrame([(1, 0, "pass"), (2, 0, "pass"), (2, 1, "range"), (3, None, None)], "k int, claim int, outcome string")
    assert {r.k: r.state for r in claims.verdicts(outcomes, "k").collect()} == {1: "pass", 2: "fail", 3: "fail"}


def test_diff_rows_end_by_count():
    good = "--- a/f\n+++ b/f\n@@ -1,2 +1 @@\n keep\n--- looks like a header\n"
    assert [r[4] for r in patches.diff_rows(good)] == [" ", "-"]
    assert [r[4] for r in patches.diff_rows("--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n+c\n")] == ["-", "+", "!"]
    assert [r[4] for r in patches.diff_rows("--- a/f\n+++ b/g\n")] == ["!"]
    assert [r[4] for r in patches.diff_rows("--- a/f\n+++ b/f\n@@ -1,3 +1 @@\n-a\n")] == ["-", "!"]
    assert list(patches.diff_rows(None)) == []


def test_patch_overlap(spark):
    diff = "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n a\n b\n@@ -2 +2 @@\n-b\n+c\n"
    rows = spark.createDataFrame([(1, diff, "f", "a\nb\n")], "k int, diff string, path string, text string")
    lines = patches.patch_lines(rows, "k", "diff")
    assert patches.overlaps(lines, "k").count() == 1
    assert patches.verdicts(rows, lines, rows, "k", "diff").first().state == "fail"


def test_reconcile_precedence(spark):
    schema = "path string, hash string, mode string"
    manifest = spark.createDataFrame([("a", "1", "m"), ("b", "1", "m"), ("c", "1", "m"), ("d", "1", "m")], schema)
    found = spark.createDataFrame([("a", "1", "m"), ("b", "2", "x"), ("c", "1", "x"), ("e", "1", "m")], schema)
    outcome = fingerprint.reconciled(manifest, found, ["path"], {"hash": "hash", "mode": "mode"})
    assert {r.path: r.outcome for r in outcome.collect()} == {"a": "ok", "b": "hash", "c": "mode", "d": "missing", "e": "extra"}


def test_closure_outcome(spark):
    checks = spark.createDataFrame([(1, "id", True), (2, "id", False), (3, "id", False), (3, "versions", False)], "k int, check string, ok boolean")
    assert {r.k: r.outcome for r in closure.outcome(checks, "k").collect()} == {1: "closed", 2: "mismatch", 3: "unavailable"}


def test_retries(spark):
    calls = spark.createDataFrame([(1, 1, "k", False), (1, 2, "other", False), (1, 3, "k", True), (1, 4, "k", False), (1, 5, "other", False), (1, 6, None, False)], "session_id int, seq int, key string, finishes boolean")
    assert [r.answer for r in logs.retries(calls).orderBy("seq").collect()] == ["proceed", "busy", "proceed", "replay", "finished", "finished"]


def test_films_of_unequal_length(spark):
    left = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "w int, t int, film string")
    right = spark.createDataFrame([(1, 1, "a")], "w int, t int, film string")
    assert films.divergence(left, right, "w").first() == Row(w=1, first_divergence=2, epochs=2, identical=False)


def test_tests_verdict(spark):
    episodes = spark.createDataFrame([(i, i != 1, i != 4) for i in range(1, 6)], "k int, has_plan boolean, has_patch boolean")
    rows = spark.createDataFrame([(2, "baseline", None, False), (3, "patched", "spawn", True), (4, "baseline", None, True), (5, "patched", None, True)], "k int, phase string, error string, met boolean")
    assert {r.k: r.state for r in runs.tests_verdict(episodes, rows, "k").collect()} == {1: "not_applicable", 2: "error", 3: "error", 4: "fail", 5: "pass"}


def test_canonical_text(spark):
    rows = spark.createDataFrame([('{"b": 1.0, "a": [1, null]}',), ("nope",), (None,)], "j string")
    assert [r.c for r in rows.select(identity.canonical_text("j").alias("c")).collect()] == ['{"a":[1,null],"b":1.0}', None, None]


def test_readers_keep_what_does_not_parse(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "receipt.json").write_text('{"episode_id": "e", "reward": null, "status": "ok"}')
    (tmp_path / "receipt.json").write_text("broken")
    rows = artifacts.parsed(artifacts.files(spark, str(tmp_path), "receipt.json"), "receipts").collect()
    assert sorted((r.doc.episode_id or "", r.raw[:6]) for r in rows) == [("", "broken"), ("e", '{"epis')]
    assert sorted(r.path for r in artifacts.tree(spark, str(tmp_path)).collect()) == ["receipt.json", "x/receipt.json"]


def test_platforms(spark):
    cases = {"macOS-aarch64": ("darwin", "arm64"), "Linux-AMD64": ("linux", "x86_64"), "win32-x86_64": ("windows", "x86_64"), "linux-riscv-64": ("linux", "riscv-64"), "Plan9": ("plan9", "unknown"), "": ("", "unknown")}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", C.platform(F.col("p")).alias("x")).collect()
    assert {r.p: (r.x.os, r.x.arch) for r in rows} == cases


def test_terminations(spark):
    rows = spark.createDataFrame([(e, t) for e in (True, False) for t in (True, False)], "e boolean, t boolean").select("e", "t", C.termination(F.col("e"), F.col("t")).alias("x")).collect()
    assert {(r.e, r.t): r.x for r in rows} == {(True, True): "timed_out", (True, False): "exited", (False, True): "not_executed", (False, False): "not_executed"}


def test_claims_are_complete(spark):
    schema = "id int, claims array<struct<statement:string,citations:array<struct<path:string,start_line:int,end_line:int,quote:string>>>>"
    good = ("a/b", 2, 3, "q")
    cases = {
        "pass": [[("says", [good])], [("says", [good, good]), ("and", [good])]],
        "fail": [[], None, [("  ", [good])], [("says", [])], [("says", None)], [(None, [good])], [("says", [("", 2, 3, "q")])], [("says", [("a", 0, 3, "q")])], [("says", [("a", 3, 2, "q")])], [("says", [("a", 1, 2, None)])], [("says", [good]), ("and", [])]],
    }
    for want, rows in cases.items():
        got = spark.createDataFrame(list(enumerate(rows)), schema).select("id", claims.complete(F.col("claims")).alias("s")).collect()
        assert {r.s for r in got} == {want}


def test_map_differences_of_absent_keys_and_maps(spark):
    rows = spark.createDataFrame([({"a": "1", "b": None}, {"a": "2"}), (None, {"c": "3"}), ({"a": "1"}, {"a": "1"}), (None, None)], "l map<string,string>, r map<string,string>")
    got = [[tuple(d) for d in r.x] for r in rows.select(matrix.map_differences(F.col("l"), F.col("r")).alias("x")).collect()]
    assert got == [[("a", "1", "2")], [("c", None, "3")], [], []]


def test_shared_subject(spark):
    tasks = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "task_key int, split string")
    subjects = spark.createDataFrame([("x", "snap-1"), ("z", "snap-2")], "split string, snapshot_id string")
    got = sorted(tuple(r) for r in closure.with_subject(tasks, subjects, "split").select("task_key", "snapshot_id", "code").collect())
    assert got == [(1, "snap-1", None), (2, "snap-1", None), (3, None, "SUBJECT_MISSING"), (4, None, "SUBJECT_MISSING")]


def test_each_item_fails_alone(spark):
    from assayer.functions import registry

    def halved(items):
        return [str(int(x) // 2) for x in items]

    rows = spark.createDataFrame([(1, "4"), (2, "x"), (3, "7")], "k long, item string").coalesce(1)
    got = sorted(tuple(r) for r in registry.each(rows, "k", "item", halved).collect())
    assert got == [(1, "2", None), (2, None, "ValueError"), (3, "3", None)]


def test_quotes_are_located_word_for_word(spark):
    texts = [(1, "so he said: the quick brown fox jumps over it, twice"), (1, "the quick brown fox jumps over it"), (2, "the quick brown fox\njumps over it"), (3, "prefixthe quick brown fox jumps overs"), (4, None)]
    quotes = [(7, "the quick brown fox jumps over"), (8, "quick brown fox"), (9, "")]
    got = claims.located(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(quotes, "item long, quote string"), "k", "item")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7), (1, 7), (1, 8), (1, 8), (1, 9), (1, 9), (2, 8), (2, 9), (3, 7), (3, 8), (3, 9)]


def test_listed_trees(spark):
    files = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("l", b"1")], "path string, content binary")
    listing = spark.createDataFrame([("a", "0644", False), ("l", "0777", True), ("gone", "0644", False), ("dangling", "0777", True)], "path string, mode string, is_link boolean")
    got = {r.path: (r.mode, r.state) for r in artifacts.listed(files, listing).collect()}
    assert got == {"a": ("0644", "file"), "b": (None, "unlisted"), "l": ("0777", "link"), "gone": ("0644", "absent"), "dangling": ("0777", "link")}


def test_folds_share_one_scan_and_one_exchange(spark, tmp_path):
    from assayer.functions.registry import Fold, Registry

    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "episode_key int, state string").write.parquet(path)
    folds = {"n": ("1", Fold(lambda: F.when(F.count(F.lit(1)) > 1, "pass").otherwise("fail"))), "a": ("1", Fold(lambda: F.max("state"))), "b": ("1", Fold(lambda: F.min("state")))}
    table = spark.read.parquet(path)
    found = Registry({}).run(table, list(folds), folds, table=table)
    assert sorted((r.episode_key, r.signal, r.state) for r in found.collect()) == [(1, "a", "b"), (1, "b", "a"), (1, "n", "pass"), (2, "a", "a"), (2, "b", "a"), (2, "n", "fail")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Aggregate"), plan.count("Relation")) == (1, 1)
    with pytest.raises(ValueError):
        Registry({}).run(table, ["n"], folds)
