"""Closure: references, bindings, replay and key sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.operators import closure, runs

from . import views as V
from .catalog import register
from .views import sql


@register("jn01_split_closure", "SELECT o_orderkey, o_custkey, 'SPLIT_UNKNOWN_TASK' AS code FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def jn01(spark, d):
    members = V.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    tasks = V.table(spark, d, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return closure.dangling(members, tasks, "o_custkey", "SPLIT_UNKNOWN_TASK")


@register("jn02_reward_closure", "SELECT c_custkey, n_nationkey, 'REWARD_UNKNOWN' AS code FROM (SELECT c_custkey, c_nationkey AS n_nationkey FROM customer) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def jn02(spark, d):
    tasks = V.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return closure.dangling(tasks, V.table(spark, d, "nation").filter("n_regionkey < 3"), "n_nationkey", "REWARD_UNKNOWN")


@register("jn03_subject_binding", "SELECT l_orderkey, l_suppkey, nation, 'SUBJECT_MISMATCH' AS code FROM (SELECT l_orderkey, l_suppkey, l_partkey % 25 AS nation FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey WHERE nation IS DISTINCT FROM s_nationkey")
def jn03(spark, d):
    refs = V.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_partkey") % 25).alias("nation"))
    verified = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    return closure.unbound(refs, verified, "l_suppkey", ["nation"], "SUBJECT_MISMATCH")


_DERIVED = "SELECT episode_key, signal, CASE WHEN episode_key % 17 = 0 AND signal = 's1' THEN 'fail' ELSE state END AS state FROM signal_states WHERE NOT (episode_key % 19 = 0 AND signal = 's2')"


def _recorded_and_derived(spark, d):
    states = V.signal_states(spark, d)
    changed = F.when((F.col("episode_key") % 17 == 0) & (F.col("signal") == "s1"), "fail").otherwise(F.col("state"))
    return states, states.filter("not (episode_key % 19 = 0 and signal = 's2')").withColumn("state", changed)


@register("jn16_replay", sql(f"SELECT episode_key, signal, coalesce(r.state = d.state, false) AS agrees FROM signal_states r FULL JOIN ({_DERIVED}) d USING (episode_key, signal)", "signal_states"))
def jn16(spark, d):
    recorded, derived = _recorded_and_derived(spark, d)
    return closure.replayed(recorded, derived, ["episode_key", "signal"], "state")


@register("agg17_closure_outcome", sql(f"""WITH c AS (SELECT episode_key, signal, coalesce(r.state = d.state, false) AS agrees FROM signal_states r FULL JOIN ({_DERIVED}) d USING (episode_key, signal)),
k AS (SELECT episode_key, 'signal:' || signal AS chk, agrees AS ok FROM c UNION ALL SELECT DISTINCT episode_key, 'versions', episode_key % 29 <> 0 FROM c)
SELECT episode_key, CASE WHEN bool_or(chk = 'versions' AND NOT ok) THEN 'unavailable' WHEN bool_or(NOT ok) THEN 'mismatch' ELSE 'closed' END AS outcome,
coalesce(string_agg(chk, ', ' ORDER BY chk) FILTER (NOT ok), '') AS failed FROM k GROUP BY 1""", "signal_states"))
def agg17(spark, d):
    recorded, derived = _recorded_and_derived(spark, d)
    replay = closure.replayed(recorded, derived, ["episode_key", "signal"], "state").select("episode_key", F.concat(F.lit("signal:"), "signal").alias("check"), F.col("agrees").alias("ok"))
    versions = recorded.select("episode_key").distinct().select("episode_key", F.lit("versions").alias("check"), (F.col("episode_key") % 29 != 0).alias("ok"))
    return closure.outcome(replay.union(versions), "episode_key")


@register("agg18_failed_checks", sql(f"""SELECT episode_key, string_agg('signal:' || signal, ', ' ORDER BY signal) AS failed FROM (SELECT episode_key, signal, coalesce(r.state = d.state, false) AS agrees
FROM signal_states r FULL JOIN ({_DERIVED}) d USING (episode_key, signal)) WHERE NOT agrees GROUP BY 1""", "signal_states"))
def agg18(spark, d):
    return agg17(spark, d).select("episode_key", F.trim(F.regexp_replace("failed", ",? ?versions$", "")).alias("failed")).filter("failed <> ''")


@register("jn18_verifier_drift", """SELECT signal, a.version AS sealed, b.version AS available, CASE WHEN a.version IS NOT DISTINCT FROM b.version THEN 'same' ELSE 'unavailable' END AS outcome
FROM (SELECT p_brand AS signal, max(p_size) AS version FROM part WHERE p_partkey % 3 <> 0 AND p_brand <> 'Brand#11' GROUP BY 1) a FULL JOIN (SELECT p_brand AS signal, max(p_size) AS version FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1) b USING (signal)""")
def jn18(spark, d):
    part = V.table(spark, d, "part")
    side = lambda rows, name: rows.groupBy(F.col("p_brand").alias("signal")).agg(F.max("p_size").alias(name))
    both = side(part.filter("p_partkey % 3 <> 0 and p_brand <> 'Brand#11'"), "sealed").join(side(part.filter("p_partkey % 5 <> 0"), "available"), "signal", "full")
    return both.withColumn("outcome", F.when(C.differs(F.col("sealed"), F.col("available")), "unavailable").otherwise("same"))


@register("jn19_plan_vs_registry", sql("SELECT episode_key, signal, 'NO_IMPLEMENTATION' AS code FROM signal_states WHERE signal > 's3'", "signal_states"))
def jn19(spark, d):
    from .registry_queries import REGISTRY

    return closure.dangling(V.signal_states(spark, d).select("episode_key", "signal"), F.broadcast(REGISTRY.frame(spark).select("signal")), "signal", "NO_IMPLEMENTATION")


@register("sca24_version_pair", sql("SELECT signal, 'v' || weight AS contract, CASE WHEN signal <= 's3' THEN '1' END AS implementation FROM rubric", "rubric"))
def sca24(spark, d):
    from .registry_queries import REGISTRY

    signals = V.signal_states(spark, d).select("signal").distinct()
    contract = F.broadcast(spark.createDataFrame([(s, f"v{w}") for s, w, _ in V.RUBRIC], "signal string, contract string"))
    return signals.join(contract, "signal").join(F.broadcast(REGISTRY.frame(spark)), "signal", "left").select("signal", "contract", F.col("version").alias("implementation"))


@register("jn23_evidence_fields", "SELECT key, CASE WHEN a IS NULL THEN 'uncited' ELSE 'no_evidence' END AS code FROM (SELECT DISTINCT l_orderkey AS key, 1 AS a FROM lineitem WHERE l_linenumber = 1) x FULL JOIN (SELECT o_orderkey AS key, 1 AS b FROM orders WHERE o_orderkey % 7 <> 0) y USING (key) WHERE a IS NULL OR b IS NULL")
def jn23(spark, d):
    cited = V.table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("key"), F.lit(1).alias("a")).distinct()
    stored = V.table(spark, d, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("key"), F.lit(1).alias("b"))
    return cited.join(stored, "key", "full").filter("a is null or b is null").select("key", F.when(F.col("a").isNull(), "uncited").otherwise("no_evidence").alias("code"))


@register("jn24_unmet_needs", "SELECT c_custkey, need FROM (SELECT c_custkey, unnest(['n' || c_nationkey, 'm' || (c_custkey % 9)]) AS need FROM customer) WHERE need NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey <> 1) AND need NOT IN (SELECT 'm' || r_regionkey FROM region)")
def jn24(spark, d):
    needs = V.table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("m"), F.col("c_custkey") % 9))).alias("need"))
    provided = V.table(spark, d, "nation").filter("n_regionkey <> 1").select(F.concat(F.lit("n"), "n_nationkey").alias("need")).union(V.table(spark, d, "region").select(F.concat(F.lit("m"), "r_regionkey")))
    return closure.dangling(needs, provided, "need", "").select("c_custkey", "need")


@register("jn26_entrypoint_membership", "SELECT s_suppkey, entry FROM (SELECT s_suppkey, 'part/' || (s_suppkey * 21) AS entry FROM supplier) WHERE entry NOT IN (SELECT 'part/' || p_partkey FROM part)")
def jn26(spark, d):
    entries = V.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("part/"), F.col("s_suppkey") * 21).alias("entry"))
    return closure.dangling(entries, V.table(spark, d, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("entry")), "entry", "").select("s_suppkey", "entry")


@register("win01_canonical_order", "SELECT owner, pos, member FROM (SELECT *, lag(member) OVER (PARTITION BY owner ORDER BY pos) AS b FROM (SELECT user_id AS owner, event_id AS pos, event_type AS member FROM events)) WHERE b >= member")
def win01(spark, d):
    return closure.noncanonical(V.table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("pos"), F.col("event_type").alias("member")), "owner", "pos", "member")


_BODY = """'{"submission_version":1' || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"finding":{}' END || ',"patch":null' || CASE WHEN event_id % 7 = 0 THEN ',"note":1' ELSE '' END || CASE WHEN event_id % 11 = 0 THEN ',"episode_id":2' ELSE '' END || '}'"""


@register("flt11_exact_key_set", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'finding' ELSE '' END AS missing, CASE WHEN event_id % 7 = 0 THEN 'note' ELSE '' END AS unknown, CASE WHEN event_id % 11 = 0 THEN 'episode_id' ELSE '' END AS server_owned
FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0""")
def flt11(spark, d):
    docs = V.table(spark, d, "events").select("event_id", F.expr(_BODY).alias("body"))
    return closure.key_set(docs, "event_id", "body", ["submission_version", "finding", "patch"], ["episode_id", "reward", "status"])


@register("flt14_prebound_refusal", "SELECT o_orderkey, 'PREBOUND_ID' AS code FROM orders WHERE o_orderkey % 6 = 0")
def flt14(spark, d):
    declared = V.table(spark, d, "orders").withColumn("episode_id", F.when(F.col("o_orderkey") % 6 == 0, C.content_id("episode", F.col("o_orderkey").cast("string"))))
    return declared.filter(F.col("episode_id").isNotNull()).select("o_orderkey", F.lit("PREBOUND_ID").alias("code"))


@register("flt15_member_audit", sql("""SELECT snapshot, path, 'forbidden' AS code FROM files WHERE prefix(path, 'es/') OR suffix(path, '7.txt')
UNION ALL SELECT snapshot, m, 'absent' FROM (SELECT DISTINCT snapshot FROM files), (SELECT unnest(['en/1.txt', 'en/2.txt']) AS m) WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.snapshot = files.snapshot AND f.path = m)""", "files").replace("(SELECT DISTINCT snapshot FROM files), (SELECT unnest", "(SELECT DISTINCT snapshot FROM files) s, (SELECT unnest").replace("f.snapshot = files.snapshot", "f.snapshot = s.snapshot"))
def flt15(spark, d):
    return closure.member_audit(V.files(spark, d), "snapshot", "path", ["en/1.txt", "en/2.txt"], ["es/"], ["7.txt"])


@register("flt10_evaluable_profile", "SELECT n_nationkey, r_name, r_name IN ('ASIA', 'EUROPE') AS evaluable FROM nation JOIN region ON n_regionkey = r_regionkey")
def flt10(spark, d):
    regions = V.table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return V.table(spark, d, "nation").join(regions, "n_regionkey").select("n_nationkey", "r_name", F.col("r_name").isin("ASIA", "EUROPE").alias("evaluable"))


@register("flt09_policy_honesty", """SELECT c_custkey, CASE WHEN c_nationkey % 5 = 4 THEN 'unknown_profile' ELSE 'network_not_provided' END AS code FROM customer
WHERE c_nationkey % 5 = 4 OR (c_nationkey % 5 IN (0, 1, 2) AND c_custkey % 3 <> (c_nationkey % 5))""")
def flt09(spark, d):
    policies = V.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("p"), F.col("c_nationkey") % 5).alias("runner_profile"), F.concat(F.lit("net"), F.col("c_custkey") % 3).alias("network"))
    profiles = V.table(spark, d, "region").filter("r_regionkey < 4").select(F.concat(F.lit("p"), "r_regionkey").alias("runner_profile"), F.concat(F.lit("net"), "r_regionkey").alias("network"), (F.col("r_regionkey") < 3).alias("executes"))
    return runs.policy_violations(policies, profiles).select("c_custkey", "code")


def _runs(spark, d):
    lines = V.table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    return lines.select(
        F.col("l_orderkey").alias("episode_key"), F.when(F.col("l_linenumber") % 2 == 0, "patched").otherwise("baseline").alias("phase"), (q % 3).alias("exit_code"),
        F.when(q % 5 != 0, F.array(F.lit(0), F.lit(1), F.lit(2))).alias("expected_exit_codes"), F.when((F.col("l_partkey") % 50) == 0, "spawn").alias("error"),
    )


_RUNS = """(SELECT l_orderkey AS episode_key, CASE WHEN l_linenumber % 2 = 0 THEN 'patched' ELSE 'baseline' END AS phase, trunc(l_quantity)::INT % 3 AS exit_code,
CASE WHEN l_partkey % 50 = 0 THEN 'spawn' END AS error, CASE WHEN trunc(l_quantity)::INT % 5 <> 0 THEN true ELSE trunc(l_quantity)::INT % 3 = 0 END AS met FROM lineitem)"""


@register("jn21_run_vs_expectation", f"SELECT episode_key, phase, exit_code, met, count(*) AS n FROM {_RUNS} GROUP BY ALL")
def jn21(spark, d):
    return runs.expected(_runs(spark, d)).groupBy("episode_key", "phase", "exit_code", "met").agg(F.count(F.lit(1)).alias("n"))


@register("agg14_tests_verdict", f"""SELECT episode_key, CASE WHEN episode_key % 9 = 0 THEN 'not_applicable' WHEN coalesce(broke, true) OR NOT b THEN 'error' WHEN episode_key % 8 = 0 OR NOT p THEN 'fail' ELSE 'pass' END AS state
FROM (SELECT o_orderkey AS episode_key FROM orders GROUP BY 1) LEFT JOIN (SELECT episode_key, bool_or(error IS NOT NULL) AS broke, coalesce(bool_and(met) FILTER (phase = 'baseline'), true) AS b, coalesce(bool_and(met) FILTER (phase = 'patched'), true) AS p FROM {_RUNS} GROUP BY 1) USING (episode_key)""")
def agg14(spark, d):
    k = F.col("o_orderkey")
    episodes = V.table(spark, d, "orders").select(k.alias("episode_key"), (k % 9 != 0).alias("has_plan"), (k % 8 != 0).alias("has_patch")).distinct()
    return runs.tests_verdict(episodes, runs.expected(_runs(spark, d)), "episode_key")


@register("sca08_command_normalise", "SELECT p_partkey, 'sh -c p' || p_size || ' ' || p_size || '.py' AS command FROM part")
def sca08(spark, d):
    argv = F.array(F.lit("/bin/sh"), F.lit("-c"), F.concat(F.lit("p"), "p_size"), F.concat(F.lit("/opt/x/"), "p_size", F.lit(".py")))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(C.command(argv), " ").alias("command"))


@register("sca09_command_id", """SELECT p_partkey, 'cmd-' || sha256('{"args":["' || p_size || '"],"cwd":"' || CASE WHEN p_partkey % 2 = 0 THEN 'src' ELSE '.' END || '","tool":"' || p_brand || '"}') AS id FROM part""")
def sca09(spark, d):
    return V.table(spark, d, "part").select("p_partkey", C.command_id(F.col("p_brand"), F.array(F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 2 == 0, "src")).alias("id"))


@register("sca10_platform", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'darwin' WHEN 1 THEN 'windows' WHEN 2 THEN 'linux' ELSE 'plan9' END AS os, CASE p_partkey % 4 WHEN 0 THEN 'arm64' WHEN 1 THEN 'x86_64' WHEN 2 THEN 'riscv-64' ELSE 'unknown' END AS arch FROM part")
def sca10(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("macOS-aarch64", "Win32-AMD64", "linux-RISCV-64", "Plan9"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", C.platform(raw).alias("x")).select("p_partkey", "x.os", "x.arch")


@register("sca11_termination", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'not_executed' WHEN p_partkey % 3 = 0 THEN 'timed_out' ELSE 'exited' END AS termination FROM part")
def sca11(spark, d):
    return V.table(spark, d, "part").select("p_partkey", C.termination(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 3 == 0).alias("termination"))


@register("set07_tool_set", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS tools FROM orders GROUP BY 1")
def set07(spark, d):
    return V.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("tools"))


@register("sca07_glob_regex", sql("SELECT path, regexp_full_match(path, '.*/1.[.]txt') AS one, regexp_full_match(path, '[de]./.*[^0-4][.]txt') AS two FROM files", "files"))
def sca07(spark, d):
    return V.files(spark, d).select("path", C.matches_any(F.col("path"), ["*/1?.txt"]).alias("one"), C.matches_any(F.col("path"), ["[de]?/*[!0-4].txt"]).alias("two"))
