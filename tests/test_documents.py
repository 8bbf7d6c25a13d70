"""Ids of documents against a plain restatement of their definition."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import identity
from assayer.operators import documents


def plain_id(kind, doc):
    return f"{kind}-" + hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


NAMES = ["a", "b/c", 'q"uote', "back\\slash", "\\u000b", "tab\t", "nl\n", "vt\x0b", "esc\x1b\x1b", "\\\x1f", "é", "～", "\U0001f600", "", " ", "z" * 300]


def test_json_strings(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = {r.n: r.j for r in rows.select("n", identity.json_string(F.col("n")).alias("j")).collect()}
    assert got == {n: json.dumps(n, ensure_ascii=False) for n in NAMES}


@pytest.mark.parametrize("parts", [1, 5])
def test_snapshot_ids(spark, parts):
    rng = random.Random(parts)
    headers, files, want = [], [], {}
    for s in range(6):
        config = None if s == 0 else json.dumps({"n": 1.50, "deep": [{"z": None, "a": "é"}], "x": 1e-7})
        paths = rng.sample(NAMES, s * 2)
        own = {p: (f"sha256:{i}", rng.choice(["0644", "0755"])) for i, p in enumerate(paths)}
        exclusions, binary = rng.sample(NAMES, s), None if s == 1 else ["b", "a"]
        headers.append((s, "v1", exclusions, binary, None if s % 2 else "r1", config))
        files += [(s, p, h, m) for p, (h, m) in own.items()]
        want[s] = plain_id("snap", {"snapshot_version": "v1", "files": {p: h for p, (h, _) in own.items()}, "file_modes": {p: m for p, (_, m) in own.items()}, "exclusions": sorted(exclusions), "binary_paths": sorted(binary or []), "base_revision": None if s % 2 else "r1", "visible_config": json.loads(config) if config else {}})
    files.append((99, "p", "h", "0644"))  # without a header
    h = spark.createDataFrame(headers, "s int, snapshot_version string, exclusions array<string>, binary_paths array<string>, base_revision string, visible_config string")
    f = spark.createDataFrame(files, "s int, path string, hash string, mode string").repartition(parts)
    assert {r.s: r.id for r in documents.snapshot_ids(h, f, ["s"]).collect()} == want


def test_bundle_and_environment_ids(spark):
    members = [("b", p, f"h{i}", "0644") for i, p in enumerate(NAMES)]
    header = spark.createDataFrame([("b", "v", "env-1"), ("empty", "v", "env-2")], "k string, bundle_version string, env_id string")
    got = {r.k: r.id for r in documents.bundle_ids(header, spark.createDataFrame(members, "k string, path string, hash string, mode string"), ["k"]).collect()}
    listed = [{"path": p, "sha256": h, "mode": m} for _, p, h, m in sorted(members, key=lambda x: x[1])]
    assert got == {"b": plain_id("bundle", {"bundle_version": "v", "env_id": "env-1", "members": listed}), "empty": plain_id("bundle", {"bundle_version": "v", "env_id": "env-2", "members": []})}
    tasks = [(1, f"t{i}", f"task-{(i * 7) % 10}") for i in range(10)]
    rewards = [(1, "r1", "rew-2"), (1, "r2", "rew-1")]
    splits = [(1, "train", "task-3"), (1, "train", "task-1"), (1, "train", "task-1"), (1, "test", "task-2"), (1, "none", None)]
    h = spark.createDataFrame([(1, "v", "p", '{"b": 1, "a": [2]}', None)], "k int, environment_version string, substrate_profile string, subject string, profiles string")
    got = documents.environment_ids(h, *(spark.createDataFrame(r, s) for r, s in ((rewards, "k int, path string, reward_id string"), (tasks, "k int, path string, task_id string"), (splits, "k int, split string, task_id string"))), ["k"]).first()
    doc = {
        "environment_version": "v", "substrate_profile": "p", "subject": {"b": 1, "a": [2]}, "profiles": {}, "splits": {"train": ["task-1", "task-3"], "test": ["task-2"], "none": []},
        "tasks": sorted(({"path": p, "task_id": t} for _, p, t in tasks), key=lambda x: x["task_id"]), "rewards": sorted(({"path": p, "reward_id": r} for _, p, r in rewards), key=lambda x: x["reward_id"]),
    }
    assert got.id == plain_id("env", doc)


def test_a_large_set_streams(spark):
    """Two million entries of one set are one hash; a task's worker holds a batch."""
    n = 1_000_000
    files = spark.range(n).select(F.lit(1).alias("s"), F.format_string("d/%07d", "id").alias("path"), F.lit("h").alias("hash"), F.lit("0644").alias("mode"))
    header = spark.createDataFrame([(1, "v", None, None, None, None)], "s int, snapshot_version string, exclusions array<string>, binary_paths array<string>, base_revision string, visible_config string")
    digest = hashlib.sha256(b'{"base_revision":null,"binary_paths":[],"exclusions":[],"file_modes":{')
    for value, middle in (("0644", '},"files":{'), ("h", '},"snapshot_version":"v","visible_config":{}}')):
        for a in range(0, n, 100_000):
            digest.update(((a > 0) * "," + ",".join(f'"d/{i:07d}":"{value}"' for i in range(a, a + 100_000))).encode())
        digest.update(middle.encode())
    row = documents.snapshot_ids(header, files, ["s"]).first()
    assert row.id == f"snap-{digest.hexdigest()}"
    assert row.n_bytes > 30_000_000


DOC = {"z": None, "diff": "a\r\nb\rc\r\n\r", "events": [{"cwd": ".", "at": 1, "exit_code": None}, {}], "trace_version": "t", "reward": 1.0, "status": "ok", "subject": {"s": 1e-7}, "splits": {}, "note": "\x0b"}


def test_what_ids_cover(spark):
    rows = []
    for kind in [*identity.OWN_ID, *identity.COVERED, "trace"]:
        own = identity.OWN_ID.get(kind)
        body = DOC | ({own: "x"} if own else {})
        if kind == "trace":
            want = {"trace_version": "t", "events": [{"cwd": ".", "exit_code": None}, {}]}
        elif kind in identity.COVERED:
            want = {k: v for k, v in DOC.items() if k in identity.COVERED[kind]}
        else:
            want = DOC | ({"diff": "a\nb\nc\n\n"} if kind == "patch" else {})
        rows += [(kind, json.dumps(body), plain_id(kind, want)), (kind, "[1]", None), (kind, "{", None), (kind, None, None)]
    got = spark.createDataFrame(rows, "kind string, raw string, want string").withColumn("id", identity.document_id(F.col("kind"), F.col("raw"))).collect()
    assert [r.id for r in got] == [r.want for r in got]
    absent = spark.createDataFrame([('{"events": [{"exit_code": null}]}',), ('{"events": [{}]}',), ("{}",)], "raw string")
    assert [r[0] for r in absent.select(identity.covered_text("trace", F.col("raw"))).collect()] == ['{"events":[{"exit_code":null}],"trace_version":null}', '{"events":[{}],"trace_version":null}', '{"events":[],"trace_version":null}']


def test_ids_written_out(spark):
    from assayer.operators import claims

    text = "task-12345678 ok, sem-abcdef012345 too, cmd-12345678 no, rew-1234567 short, xtask-12345678 no, éenv-12345678 no, env-1234567g no, snap-" + "a" * 70
    files = [("a.md", text), ("b.json", '{"l": [[{"k": [{"trace_id": [1]}]}]], "n": "rew-00000000"}'), ("c.json", "{"), ("d.json", '"env_id"'), ("e.json", '[{"bundle_id": {"env_id": 1}}]'), ("f.txt", '{"env_id": 1}')]
    got = sorted(tuple(r) for r in claims.id_violations(spark.createDataFrame(files, "path string, text string"), []).fillna("-").collect())
    assert got == sorted([
        ("a.md", "literal", "task-12345678"), ("a.md", "literal", "sem-abcdef012345"), ("a.md", "literal", "snap-" + "a" * 70), ("b.json", "literal", "rew-00000000"), ("b.json", "key", "trace_id"),
        ("c.json", "not_json", "-"), ("e.json", "key", "bundle_id"), ("e.json", "key", "env_id"),
    ])
    assert claims.id_violations(spark.createDataFrame([], "path string, text string"), []).count() == 0
