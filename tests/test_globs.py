"""Shell patterns against Python's own, and logs' tests against a script's rules."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.functions import globs
from assayer.operators import claims, fingerprint, logs
from assayer.sources import sinks

PATTERNS = ["*", "?", "[", "[]", "[!]", "[]a]", "[!]a]", "[^a]", "[!a]", "[[]", "[a&&b]", "[a||b]", "[a-c]", "[c-a]", "[!c-a]", "[a-]", "[-a]", "[a-c-e]", "[--a]", "[a--b]", "a[", "a[b", "a.b", "a+b", "(a)", "a{1}", "\\a", "[\\a]", "a$", "^a", "x/*/y", "*.txt", "[é-ü]x", "a\nb", "?\n", "[0-9]*[!.]", "[!!]", "[a!]", "[~~a]", "*[", "[a-\\]"]
PATHS = ["", "a", "b", "c", "e", "d", "!", "-", "]", "[", "^", "&", "|", "~", "\\", "\\a", "a]", "a[", "a[b", "a.b", "axb", "a+b", "aab", "(a)", "a{1}", "a$", "^a", "x/p/q/y", "x//y", "d/n.txt", "n.txt\n", "öx", "a\nb", "a\n", "5.", "57", "é", "[]", "[!]", "\U0001f600", "b]", "a\r", "a\u0085"]


def test_as_fnmatch_has_it(spark):
    rng = random.Random(3)
    letters = "ab[]!^-&.*?/\\c"
    patterns = PATTERNS + ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(150)]
    paths = PATHS + ["".join(rng.choices("ab]!^-&./c[", k=rng.randint(1, 4))) for _ in range(60)]
    pairs = [(p, g, fnmatch.fnmatchcase(p, g)) for p in paths for g in patterns]
    rows = spark.createDataFrame(pairs, "path string, glob string, want boolean").withColumn("got", globs.matches("path", "glob"))
    assert [(r.path, r.glob) for r in rows.filter("got <> want").collect()] == []
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    for some in (patterns[i : i + 40] for i in range(0, len(patterns), 40)):
        got = frame.select("path", *[C.matches_any(F.col("path"), [g]).alias(f"g{i}") for i, g in enumerate(some)]).collect()
        assert [(r[0], g) for r in got for g, ok in zip(some, r[1:], strict=True) if ok != fnmatch.fnmatchcase(r[0], g)] == []


def writable(path, patterns):
    return any(p in (".", "./") or fnmatch.fnmatchcase(path, p) or (p.endswith("/") and path.startswith(p)) for p in patterns)


@pytest.mark.parametrize("seed", [1, 2])
def test_uncovered_paths(spark, seed):
    rng = random.Random(seed)
    part = lambda: "".join(rng.choices("ab", k=rng.randint(1, 2)))
    paths = [(k, "/".join(part() for _ in range(rng.randint(1, 4)))) for k in range(12) for _ in range(40)]
    policies = {k: [rng.choice(["", "/"]).join([rng.choice(["a", "b/", "*", "?", "[!a]", "[", "a*/", "ab/b", "./", ""]) for _ in range(rng.randint(1, 4))]) for _ in range(rng.randint(0, 4))] for k in range(11)}
    policies[3] = [".", "x"]
    policies[4] = None
    got = fingerprint.uncovered(spark.createDataFrame(paths, "k int, path string"), spark.createDataFrame(list(policies.items()), "k int, writable array<string>"), ["k"])
    assert sorted(map(tuple, got.collect())) == sorted((k, p) for k, p in paths if not writable(p, policies.get(k) or []))


def test_patterns_of_a_write_policy(spark):
    rows = spark.createDataFrame([("out5.txt",), ("outa.txt",), ("a[.txt",)], "path string")
    policy = spark.createDataFrame([(["out[!0-9].txt", "a[.txt"],)], "writable array<string>").withColumn("k", F.lit(1))
    assert [r.path for r in fingerprint.escapes(rows.withColumn("k", F.lit(1)), policy, ["k"]).collect()] == ["out5.txt"]


def test_where_as_a_script_has_it(spark):
    schema = "i int, s string, d double, b boolean, n long, f float, m decimal(9,3)"
    rows = spark.createDataFrame([
        (1, "", 0.0, False, 0, 0.5, None), (2, "0", 20.0, True, 20, 1e-3, None), (3, "false", float("nan"), None, None, None, None), (4, None, 1e21, True, 1, 2.0, None), (5, "NaN", -0.0, False, -1, 0.0, None),
        (6, "x", 1.5e-7, None, 5, None, None), (7, "y", 12345678.25, None, 6, None, None), (8, "z", 1e300, None, 7, None, None), (9, "w", None, None, 8, None, None), (10, "v", float("inf"), None, 9, None, None), (11, "u", 0.1, None, 9, None, None), (12, "t", -123456789012.5, None, 9, None, None),
    ], schema)
    ids = lambda *tests: [r.i for r in logs.where(rows, *tests).orderBy("i").collect()]
    assert ids("s") == [2, 3, 5, 6, 7, 8, 9, 10, 11, 12]
    assert ids("d") == [2, 4, 6, 7, 8, 10, 11, 12]
    assert ids("b") == [2, 4] and ids("n") == [2, 4, 5, 6, 7, 8, 9, 10, 11, 12] and ids("nothing") == []
    assert ids("d=20") == [2] and ids("n=20") == [2] and ids("d!=20", "s") == [3, 5, 6, 7, 8, 9, 10, 11, 12]
    assert ids("d=0") == [1, 5] and ids("d=NaN") == [3] and ids("d=1e+21") == [4] and ids("d=1.5e-7") == [6] and ids("d=12345678.25") == [7] and ids("d=1e+300") == [8]
    assert ids("d=undefined") == [9] and ids("d=Infinity") == [10] and ids("d=0.1") == [11] and ids("d=-123456789012.5") == [12] and ids("s!=x", "s!=y", "n=9") == [10, 11, 12]
    assert ids("b=true") == [2, 4] and ids("nothing=undefined", "i=3") == [3] and ids("nothing!=1", "i=3") == [3] and ids("f=0.001") == [2] and ids("s=") == [1]


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id string, content string"
    spark.createDataFrame([("x", "1")], schema).write.parquet(path)
    new = spark.createDataFrame([("y", "2"), ("y", "1"), ("y", "1"), ("x", "1"), ("x", "9"), ("z", None), ("z", "3"), ("z", None)], schema)
    found = [sorted((r.id, r.content or "-") for r in df.collect()) for df in fingerprint.appended(spark.read.parquet(path), new, "id", "content")]
    assert found == [[("y", "1"), ("z", "-")], [("x", "1"), ("y", "1"), ("z", "-")], [("x", "9"), ("y", "2"), ("z", "3")]]
    for _ in range(2):
        conflicts = sinks.append_once(new, path, "id", "content")
        assert sorted((r.id, r.content) for r in conflicts.collect()) == [("x", "9"), ("y", "2"), ("z", "3")]
        assert sorted((r.id, r.content or "-") for r in spark.read.parquet(path).collect()) == [("x", "1"), ("y", "1"), ("z", "-")]


def test_a_claim_without_citations_fails(spark):
    one = {"path": "f", "start_line": 1, "end_line": 1, "quote": "one"}
    findings = {
        "good": [{"statement": "s", "citations": [one, one]}], "second": [{"statement": "s", "citations": [one]}, {"statement": "t", "citations": []}], "null": [{"statement": "s", "citations": None}], "none": [], "missing": None,
        "wrong": [{"statement": "s", "citations": [one, {**one, "quote": "two"}]}], "field": [{"statement": "s", "citations": [{**one, "start_line": None}]}], "claim": [None], "cited": [{"statement": "s", "citations": [None]}],
    }
    rows = spark.createDataFrame(list(findings.items()), f"k string, claims array<struct<statement:string,citations:{claims.CITATIONS}>>")
    files = spark.createDataFrame([("f", "one\ntwo\n")], "path string, text string")
    got = {r.k: r.state for r in claims.verdicts(claims.resolved(claims.cited(rows, "k"), files, ["path"]), "k").collect()}
    assert got == dict.fromkeys(findings, "fail") | {"good": "pass"}
