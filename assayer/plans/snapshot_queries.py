"""File sets: hashes, ids, manifests and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.functions import identity
from assayer.operators import documents, fingerprint, matrix

from . import views as V
from .catalog import register
from .views import sql


def _hashed(df):
    return df.select("snapshot", "path", C.digest(F.col("text")).alias("hash"), F.when(F.octet_length("text") % 5 == 0, "0755").otherwise("0644").alias("mode"))


_HASHED = "SELECT snapshot, path, 'sha256:' || sha256(text) AS hash, CASE WHEN octet_length(encode(text)) % 5 = 0 THEN '0755' ELSE '0644' END AS mode FROM "


def _snapshots(spark, d):
    """A header for each source: lists out of order, no base for some, open configuration."""
    odd = F.length("snapshot") % 2 == 1
    headers = V.files(spark, d).select("snapshot").distinct()
    return headers.select(
        "snapshot", F.lit("snapshot.v1").alias("snapshot_version"), F.when(odd, F.array(F.lit("build/*"), F.lit("*.pyc"))).alias("exclusions"), F.array(F.lit("é.bin"), F.lit('a"b')).alias("binary_paths"),
        F.when(F.length("snapshot") % 3 != 0, F.concat(F.lit("r-"), "snapshot")).alias("base_revision"), F.when(odd, F.concat(F.lit('{"n": 1.50, "a": [true, null], "of": "'), "snapshot", F.lit('"}'))).alias("visible_config"),
    )


@register("agg08_snapshot_rollup", sql(f"""SELECT snapshot, 'snap-' || sha256('{{"base_revision":' || CASE WHEN length(snapshot) % 3 <> 0 THEN '"r-' || snapshot || '"' ELSE 'null' END || ',"binary_paths":["a\\"b","é.bin"],"exclusions":' || CASE WHEN length(snapshot) % 2 = 1 THEN '["*.pyc","build/*"]' ELSE '[]' END
|| ',"file_modes":{{' || string_agg('"' || path || '":"' || mode || '"', ',' ORDER BY path) || '}},"files":{{' || string_agg('"' || path || '":"' || hash || '"', ',' ORDER BY path) || '}},"snapshot_version":"snapshot.v1","visible_config":'
|| CASE WHEN length(snapshot) % 2 = 1 THEN '{{"a":[true,null],"n":1.5,"of":"' || snapshot || '"}}' ELSE '{{}}' END || '}}') AS id FROM ({_HASHED} files) GROUP BY snapshot""", "files"))
def agg08(spark, d):
    return documents.snapshot_ids(_snapshots(spark, d), _hashed(V.files(spark, d)), ["snapshot"]).select("snapshot", "id")


@register("agg08_snapshot_tree", sql(f"""SELECT snapshot, 'snap-' || sha256('[' || string_agg('"' || h || '"', ',' ORDER BY run) || ']') AS id, sum(n)::BIGINT AS n FROM (
SELECT snapshot, (pos - 1) // 40 AS run, count(*) AS n, sha256('[' || string_agg('{{"path":"' || path || '","hash":"' || hash || '","mode":"' || mode || '"}}', ',' ORDER BY pos) || ']') AS h
FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY path, hash, mode) AS pos FROM ({_HASHED} files)) GROUP BY 1, 2) GROUP BY 1""", "files"))
def agg08_tree(spark, d):
    return fingerprint.tree_rolled_up(_hashed(V.files(spark, d)), ["snapshot"], "snap", ["path", "hash", "mode"], node=40)


@register("agg09_bundle_rollup", sql(f"""SELECT snapshot, 'bundle-' || sha256('{{"bundle_version":"bundle.v1","env_id":"env-' || sha256(snapshot) || '","members":[' || string_agg('{{"mode":"' || mode || '","path":"' || path || '","sha256":"' || substr(hash, 8) || '"}}', ',' ORDER BY path) || ']}}') AS id
FROM ({_HASHED} files) GROUP BY 1""", "files"))
def agg09(spark, d):
    members = _hashed(V.files(spark, d)).withColumn("hash", F.substring("hash", 8, 64))
    headers = members.select("snapshot", F.lit("bundle.v1").alias("bundle_version"), C.content_id("env", F.col("snapshot")).alias("env_id")).distinct()
    return documents.bundle_ids(headers, members, ["snapshot"]).select("snapshot", "id")


@register("agg10_environment_rollup", """WITH c AS (SELECT c_mktsegment || c_custkey // 50 AS env, 'n' || c_nationkey AS split, 'tasks/' || c_custkey || '.json' AS path, 'task-' || sha256(c_custkey::VARCHAR) AS task_id FROM customer),
s AS (SELECT env, string_agg('"' || split || '":[' || ids || ']', ',' ORDER BY split) AS splits FROM (SELECT env, split, string_agg('"' || task_id || '"', ',' ORDER BY task_id) AS ids FROM c GROUP BY ALL UNION ALL SELECT DISTINCT env, 'empty', '' FROM c) GROUP BY 1),
r AS (SELECT env, string_agg('{"path":"rewards/' || split || '.json","reward_id":"rew-' || sha256(split) || '"}', ',' ORDER BY sha256(split)) AS rewards FROM (SELECT DISTINCT env, split FROM c) GROUP BY 1),
t AS (SELECT env, string_agg('{"path":"' || path || '","task_id":"' || task_id || '"}', ',' ORDER BY task_id) AS tasks FROM c GROUP BY 1)
SELECT env, 'env-' || sha256('{"environment_version":"environment.v1","profiles":{"network":"none"},"rewards":[' || rewards || '],"splits":{' || splits || '},"subject":{"root":"s","snapshot_id":"snap-' || env || '"},"substrate_profile":"p","tasks":[' || tasks || ']}') AS id
FROM s JOIN r USING (env) JOIN t USING (env)""")
def agg10(spark, d):
    """An environment for each segment and fifty customers, a task a customer, a split and a reward a nation."""
    rows = V.table(spark, d, "customer").select(F.expr("concat(c_mktsegment, c_custkey div 50)").alias("env"), F.concat(F.lit("n"), "c_nationkey").alias("split"), F.col("c_custkey").cast("string").alias("k"))
    tasks = rows.select("env", "split", F.concat(F.lit("tasks/"), "k", F.lit(".json")).alias("path"), C.content_id("task", F.col("k")).alias("task_id"))
    rewards = rows.select("env", F.concat(F.lit("rewards/"), "split", F.lit(".json")).alias("path"), C.content_id("rew", F.col("split")).alias("reward_id")).distinct()
    envs = rows.select("env").distinct()
    headers = envs.select("env", F.lit("environment.v1").alias("environment_version"), F.lit("p").alias("substrate_profile"), F.concat(F.lit('{"snapshot_id": "snap-'), "env", F.lit('", "root": "s"}')).alias("subject"), F.lit('{ "network" : "none" }').alias("profiles"))
    members = tasks.select("env", "split", "task_id").union(envs.select("env", F.lit("empty"), F.lit(None).cast("string")))
    return documents.environment_ids(headers, rewards, tasks, members, ["env"]).select("env", "id")


@register("agg11_map_digest", sql(f"""SELECT snapshot, 'sha256:' || sha256('{{' || coalesce(string_agg('"' || path || '":"' || hash || '"', ',' ORDER BY path) FILTER (mode = '0755'), '') || '}}') AS digest FROM ({_HASHED} files) GROUP BY 1""", "files"))
def agg11(spark, d):
    rows = _hashed(V.files(spark, d)).withColumn("path", F.when(F.col("mode") == "0755", F.col("path")))
    return documents.map_digests(rows, ["snapshot"], "path", "hash")


@register("agg28_mode_offenders", sql(f"SELECT snapshot, path, mode AS observed, '0644' AS required FROM ({_HASHED} files) WHERE mode <> '0644'", "files"))
def agg28(spark, d):
    """A snapshot's map from path to modes, an entry a row."""
    return _hashed(V.files(spark, d)).filter("mode <> '0644'").select("snapshot", "path", F.col("mode").alias("observed"), F.lit("0644").alias("required"))


_RECONCILED = f"""SELECT snapshot, path, CASE WHEN f.hash IS NULL THEN 'missing' WHEN m.hash IS NULL THEN 'extra' WHEN m.hash <> f.hash THEN 'hash' WHEN m.mode <> f.mode THEN 'mode' ELSE 'ok' END AS outcome
FROM ({_HASHED} files) m FULL JOIN ({_HASHED} drifted) f USING (snapshot, path)"""


@register("jn05_manifest_reconcile", sql(_RECONCILED, "files", "drifted"))
def jn05(spark, d):
    return fingerprint.reconciled(_hashed(V.files(spark, d)), _hashed(V.drifted(spark, d)), ["snapshot", "path"], {"hash": "hash", "mode": "mode"})


@register("jn09_workspace_diff", sql(f"SELECT snapshot, path, CASE outcome WHEN 'missing' THEN 'deleted' WHEN 'extra' THEN 'created' WHEN 'hash' THEN 'modified' ELSE 'mode_changed' END AS change FROM ({_RECONCILED}) WHERE outcome <> 'ok'", "files", "drifted"))
def jn09(spark, d):
    return fingerprint.changes(_hashed(V.files(spark, d)), _hashed(V.drifted(spark, d)), ["snapshot", "path"])


@register("jn10_write_escapes", sql(f"""SELECT snapshot, path, CASE outcome WHEN 'missing' THEN 'deleted' WHEN 'extra' THEN 'created' WHEN 'hash' THEN 'modified' ELSE 'mode_changed' END AS change FROM ({_RECONCILED})
WHERE outcome <> 'ok' AND length(snapshot) % 5 <> 0 AND NOT prefix(path, 'extra/') AND NOT regexp_full_match(path, 'e.*[0-4][.]txt') AND NOT (length(snapshot) % 2 = 0 AND regexp_full_match(path, 'fr/[^0-8^].*[.]txt'))
AND path <> 'de/' || length(snapshot) || '.txt' AND NOT prefix(path, '[') AND NOT regexp_full_match(path, 'd[e^]/[1-3].*[5-9][.]t..')""", "files", "drifted"))
def jn10(spark, d):
    """Patterns of each source: a folder, globs with classes, a plain path, a bracket that is never closed; some have the root, some no folder."""
    changed = fingerprint.changes(_hashed(V.files(spark, d)), _hashed(V.drifted(spark, d)), ["snapshot", "path"])
    n = F.length("snapshot")
    own = F.array(F.lit("extra/"), F.lit("e*[0-4].txt"), F.concat(F.lit("de/"), n.cast("string"), F.lit(".txt")), F.lit("["), F.lit("d[e^]/[1-3]*[5-9].t??"))
    some = F.when(n % 5 == 0, F.array(F.lit("./"))).when(n % 2 == 0, F.array(F.lit("fr/[!0-8^]*.txt"))).otherwise(F.array().cast("array<string>"))
    policies = V.files(spark, d).select("snapshot").distinct().select("snapshot", F.concat(own, some).alias("writable"))
    return fingerprint.escapes(changed, policies, ["snapshot"])


@register("set03_missing_extra", sql("SELECT 'missing' AS side, count(*) AS n FROM (SELECT snapshot, path FROM files EXCEPT SELECT snapshot, path FROM drifted) UNION ALL SELECT 'extra', count(*) FROM (SELECT snapshot, path FROM drifted EXCEPT SELECT snapshot, path FROM files)", "files", "drifted"))
def set03(spark, d):
    a, b = V.files(spark, d).select("snapshot", "path"), V.drifted(spark, d).select("snapshot", "path")
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(a.subtract(b), "missing").union(count(b.subtract(a), "extra"))


_NEW = "SELECT lang || '/' || doc_id % 700 AS id, source AS content FROM documents WHERE doc_id % 3 <> 0"


@register("snk02_append_once", f"""WITH known AS (SELECT lang || '/' || doc_id % 700 AS id, min(source) AS content FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), n AS ({_NEW}),
held AS (SELECT n.id, coalesce(min(k.content), min(n.content)) AS content, min(k.content) IS NOT NULL AS old FROM n LEFT JOIN known k USING (id) GROUP BY 1)
SELECT id, CASE WHEN n.content <> h.content THEN 'conflict' WHEN old OR row_number() OVER (PARTITION BY id, n.content) > 1 THEN 'reused' ELSE 'added' END AS outcome, n.content FROM n JOIN held h USING (id)""")
def snk02(spark, d):
    """Ids with several contents on both sides; the outcome of every new row."""
    rows = V.table(spark, d, "documents").select(F.concat_ws("/", "lang", (F.col("doc_id") % 700).cast("string")).alias("id"), F.col("source").alias("content"), "doc_id")
    known = rows.filter("doc_id % 3 = 0").groupBy("id").agg(F.min("content").alias("content"))
    parts = fingerprint.appended(known, rows.filter("doc_id % 3 <> 0").select("id", "content"), "id", "content")
    named = [df.select("id", F.lit(name).alias("outcome"), "content") for df, name in zip(parts, ("added", "reused", "conflict"), strict=True)]
    return named[0].union(named[1]).union(named[2])


@register("jn17_digest_attest", sql("SELECT snapshot, path, 'sha256:' || sha256(d.text) = 'sha256:' || sha256(f.text) AS attested FROM files f JOIN drifted d USING (snapshot, path)", "files", "drifted"))
def jn17(spark, d):
    recorded = V.files(spark, d).select("snapshot", "path", C.digest(F.col("text")).alias("recorded"))
    return V.drifted(spark, d).join(recorded, ["snapshot", "path"]).select("snapshot", "path", (C.digest(F.col("text")) == F.col("recorded")).alias("attested"))


@register("jn04_declared_id", sql("SELECT snapshot, path, CASE WHEN doc_id % 5 = 0 THEN 'computed' WHEN doc_id % 23 = 0 THEN 'refused' ELSE 'accepted' END AS outcome FROM files", "files"))
def jn04(spark, d):
    derived = C.content_id("finding", F.col("text"))
    declared = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 23 == 0, C.content_id("finding", F.concat("text", F.lit("!")))).otherwise(derived)
    rows = V.files(spark, d).select("snapshot", "path", declared.alias("declared"), derived.alias("derived"))
    return rows.select("snapshot", "path", F.when(F.col("declared").isNull(), "computed").when(F.col("declared") == F.col("derived"), "accepted").otherwise("refused").alias("outcome"))


@register("jn20_pinned_identity", sql("SELECT f.snapshot, f.path, CASE WHEN d.text IS NULL THEN 'error' WHEN d.text <> f.text THEN 'fail' ELSE 'pass' END AS state FROM files f LEFT JOIN drifted d USING (snapshot, path)", "files", "drifted"))
def jn20(spark, d):
    pins = V.files(spark, d).select("snapshot", "path", C.content_id("task", F.col("text")).alias("before_id"))
    after = V.drifted(spark, d).select("snapshot", "path", C.content_id("task", F.col("text")).alias("after_id"))
    return fingerprint.pinned(pins, after, "snapshot")


@register("agg15_identity_verdict", sql("""SELECT snapshot, CASE WHEN bool_or(gone) THEN 'error' WHEN bool_or(moved) THEN 'fail' ELSE 'pass' END AS state, count(*) FILTER (moved) AS n_moved, min(path) FILTER (moved) AS first_moved FROM (
SELECT f.snapshot, f.path, d.text IS NULL AS gone, coalesce(d.text <> f.text, false) AS moved FROM files f LEFT JOIN drifted d USING (snapshot, path)) GROUP BY 1
UNION ALL SELECT c_mktsegment, 'not_applicable', 0, NULL FROM customer GROUP BY 1""", "files", "drifted"))
def agg15(spark, d):
    """Snapshots of files are pinned, those of market segments have no pins."""
    files = V.files(spark, d)
    pins = files.select("snapshot", "path", C.content_id("task", F.col("text")).alias("before_id"))
    after = V.drifted(spark, d).select("snapshot", "path", C.content_id("task", F.col("text")).alias("after_id"))
    subjects = files.select("snapshot").union(V.table(spark, d, "customer").select("c_mktsegment"))
    return fingerprint.identity_verdicts(subjects, pins, after, "snapshot")


@register("sca03_lf_normalise", sql("SELECT path, sha256(text) AS normal FROM files", "files"))
def sca03(spark, d):
    mixed = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "\n", "\r\n")).otherwise(F.regexp_replace("text", "\n", "\r"))
    return V.files(spark, d).select("path", F.sha2(C.lf(mixed).cast("binary"), 256).alias("normal"))


@register("sca04_content_hash", sql("SELECT path, 'sha256:' || sha256(CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END) AS hash FROM files", "files"))
def sca04(spark, d):
    return V.files(spark, d).select("path", C.content_hash(F.regexp_replace("text", "\n", "\r\n"), F.col("doc_id") % 3 == 0).alias("hash"))


@register("sca05_canonical_mode", "SELECT p_partkey, CASE WHEN (p_partkey % 512) & 73 <> 0 THEN '0755' ELSE '0644' END AS mode FROM part")
def sca05(spark, d):
    return V.table(spark, d, "part").select("p_partkey", C.canonical_mode(F.conv((F.col("p_partkey") % 512).cast("string"), 10, 8)).alias("mode"))


_RAW_PATH = "CASE doc_id % 6 WHEN 0 THEN '/' || lang WHEN 1 THEN lang || '\\\\' || doc_id WHEN 2 THEN './' || lang || '//' || doc_id WHEN 3 THEN lang || '/../' || doc_id WHEN 4 THEN 'C:/' || lang ELSE './.' END"


def _raw_paths(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.expr(_RAW_PATH).alias("path"))


@register("sca06_safe_path", "SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN lang || '/' || doc_id WHEN 2 THEN lang || '/' || doc_id END AS safe FROM documents")
def sca06(spark, d):
    return _raw_paths(spark, d).select("doc_id", C.safe_path(F.col("path")).alias("safe"))


@register("flt04_safe_path_filter", "SELECT doc_id FROM documents WHERE doc_id % 6 IN (1, 2)")
def flt04(spark, d):
    return _raw_paths(spark, d).filter(C.safe_path(F.col("path")).isNotNull()).select("doc_id")


@register("flt01_glob_exclusion", sql("SELECT snapshot, path FROM files WHERE NOT regexp_full_match(path, 'de/.*') AND NOT regexp_full_match(path, '.*[0-3][.]txt') AND NOT regexp_full_match(path, '[e^&]./.7.*')", "files"))
def flt01(spark, d):
    return V.files(spark, d).filter(~C.matches_any(F.col("path"), ["de/*", "*[0-3].txt", "[^e&&]?/?7*", "[", "x[[]*", "[9-0]*"])).select("snapshot", "path")


@register("flt02_writable_path", sql("SELECT path, prefix(path, 'en/') OR regexp_full_match(path, 'f.*[^0-6][.]txt') AS ok FROM files", "files"))
def flt02(spark, d):
    return V.files(spark, d).select("path", C.writable(F.col("path"), ["en/", "f*[!0-6].txt", "a[.txt"]).alias("ok"))


@register("flt12_portable_mode", "SELECT p_partkey, mode, CASE WHEN ('0o' || mode)[3:] IN ('0755', '0745') THEN '0755' ELSE '0644' END AS required FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '0644' WHEN 1 THEN '0755' WHEN 2 THEN '0600' ELSE '0745' END AS mode FROM part) WHERE mode NOT IN ('0644', '0755')")
def flt12(spark, d):
    mode = F.expr("CASE p_partkey % 4 WHEN 0 THEN '0644' WHEN 1 THEN '0755' WHEN 2 THEN '0600' ELSE '0745' END")
    return V.table(spark, d, "part").select("p_partkey", mode.alias("mode")).filter(~F.col("mode").isin("0644", "0755")).withColumn("required", C.canonical_mode(F.col("mode")))


@register("srt04_member_order", sql("SELECT snapshot, path, row_number() OVER (PARTITION BY snapshot ORDER BY path) AS pos FROM files", "files"))
def srt04(spark, d):
    return matrix.placed(V.files(spark, d).select("snapshot", "path"), ["snapshot"], ["path"])


@register("sca01_canonical_json", """SELECT o_orderkey, '{"clerk":' || coalesce('"' || o_orderpriority || '"', 'null') || ',"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS canonical FROM orders""")
def sca01(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", C.canonical_json(F.struct(F.col("o_orderpriority").alias("clerk"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("canonical"))


#: Kinds of documents, by turns.
_KINDS = ("snap", "finding", "patch", "rew", "task", "bundle", "episode", "env", "trace")
_KIND = f"[{', '.join(f"'{k}'" for k in _KINDS)}][o_orderkey % 9 + 1]"
_OWN = "{'snap': 'snapshot', 'finding': 'finding', 'patch': 'patch', 'rew': 'reward', 'task': 'task', 'bundle': 'bundle'}"
#: What their ids cover: all but their own id, chosen keys, or chosen keys of events.
_COVERED = f"""SELECT o_orderkey, kind, CASE kind WHEN 'episode' THEN '{{"reward":0.5,"status":"' || o_orderstatus || '","subject":{{"a":"é","b":1}}}}' WHEN 'env' THEN '{{"subject":{{"a":"é","b":1}}}}'
WHEN 'trace' THEN '{{"events":[{{"cwd":".","exit_code":null}}],"trace_version":"v"}}'
ELSE '{{"diff":"' || CASE kind WHEN 'patch' THEN 'a\\nb\\nc' ELSE 'a\\r\\nb\\rc' END || '","events":[{{"at":1,"cwd":".","exit_code":null}}],"n":' || o_orderkey || ',"reward":0.5,"status":"' || o_orderstatus || '","subject":{{"a":"é","b":1}},"trace_version":"v","z":null}}' END AS text
FROM (SELECT *, {_KIND} AS kind FROM orders)"""


def _artifacts(spark, d):
    """(o_orderkey, kind, raw): artifact documents of all kinds, as somebody might have written them."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in identity.OWN_ID.items() for x in (k, v)]), kind), F.lit("note"))
    raw = F.concat(
        F.lit('{ "z": null, "'), own, F.lit('": "x", "status" : "'), "o_orderstatus", F.lit('", "n": '), F.col("o_orderkey").cast("string"), F.lit(', "reward": 0.50, "subject": {"b": 1, "a": "\\u00e9"}, "diff": "a\\r\\nb\\rc", '),
        F.lit('"events": [{"exit_code": null, "at": 1, "cwd": "."}], "trace_version": "v"}'),
    )
    return V.table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), F.when(kind.isin("episode", "env", "trace"), F.regexp_replace(raw, '"note": "x", ', "")).otherwise(raw).alias("raw"))


@register("sca02_content_id", f"SELECT o_orderkey, kind || '-' || sha256(text) AS id FROM ({_COVERED})")
def sca02(spark, d):
    return _artifacts(spark, d).select("o_orderkey", identity.document_id(F.col("kind"), F.col("raw")).alias("id"))


@register("prj01_identity_allow_list", f"SELECT o_orderkey, text AS covered FROM ({_COVERED}) WHERE kind IN ('episode', 'env')")
def prj01(spark, d):
    rows = _artifacts(spark, d).filter(F.col("kind").isin("episode", "env"))
    return rows.select("o_orderkey", identity.covered_text(F.col("kind"), F.col("raw")).alias("covered"))


@register("prj02_drop_self_id", """SELECT o_orderkey, '{"status":"' || o_orderstatus || '"}' AS rest FROM orders""")
def prj02(spark, d):
    whole = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return V.table(spark, d, "orders").select("o_orderkey", whole.alias("x")).select("o_orderkey", C.canonical_json(F.col("x").dropFields("id")).alias("rest"))


@register("sca22_truncate_output", sql("SELECT path, sha256(unhex(substr(hex(encode(text)), 1, 200))) AS head, strlen(text) > 100 AS truncated FROM files", "files"))
def sca22(spark, d):
    cut = C.truncated(F.col("text").cast("binary"), 100)
    return V.files(spark, d).select("path", cut.alias("x")).select("path", F.sha2("x.content", 256).alias("head"), "x.truncated")


@register("sca23_strict_utf8", sql("SELECT path, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE length(text) END AS n FROM files", "files"))
def sca23(spark, d):
    broken = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\xff"))).otherwise(F.col("text").cast("binary"))
    return V.files(spark, d).select("path", F.length(C.strict_utf8(broken)).cast("long").alias("n"))
