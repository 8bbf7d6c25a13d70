"""Evaluation tables derived from the star schema, and the same views in DuckDB's SQL.

`sql(body, *views)` puts the named views and all that they build on before a body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators import scoring

#: (signal, weight in hundredths, required)
RUBRIC = (("s1", 25, True), ("s2", 20, True), ("s3", 20, False), ("s4", 15, False), ("s5", 10, False), ("s6", 5, False), ("s7", 5, False))
#: (signal, state, most reward in hundredths)
CAPS = (("s1", "fail", 25), ("s2", "fail", 25), ("s3", "fail", 40))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _state(rows) -> tuple:
    """(state, whether there are lines) of the lines that `rows` holds for, as one fold of whole numbers."""
    error = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (F.col("l_partkey") % 8 == 0)
    some = lambda test: F.max(F.when(rows & test, 1).otherwise(0)) == 1
    state = F.when(some(error), "error").when(some(F.col("l_returnflag") == "A"), "pass").when(some(F.col("l_returnflag") == "R"), "fail").otherwise("not_applicable")
    return state, some(F.lit(True))


def signal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_key, signal, state): lines of an order, folded."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("episode_key"), "l_linenumber").agg(_state(F.lit(True))[0].alias("state")).select("episode_key", F.concat(F.lit("s"), "l_linenumber").alias("signal"), "state")


def rubric(spark: SparkSession) -> DataFrame:
    """One row: the arrays that scoring.score wants."""
    signals = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(w).cast("long").alias("weight")) for s, w, _ in RUBRIC])
    caps = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(x).alias("state"), F.lit(m).cast("long").alias("reward_max")) for s, x, m in CAPS])
    return spark.range(1).select(F.lit("r1").alias("reward_id"), signals.alias("signals"), F.array(*[F.lit(s) for s, _, r in RUBRIC if r]).alias("required"), caps.alias("caps"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_key, reward_id, tampered, verification): a total map of states; a signal without lines failed."""
    lines = table(spark, sf_dir, "lineitem")
    states = []
    for number in range(1, len(RUBRIC) + 1):
        state, there = _state(F.col("l_linenumber") == number)
        states.append(F.when(there, state).otherwise("fail").alias(f"s{number}"))
    # One fold for all signals of an episode: one shuffle, and no list is gathered.
    folded = lines.groupBy(F.col("l_orderkey").alias("episode_key")).agg(*states)
    total = F.map_from_arrays(F.array(*[F.lit(s) for s, _, _ in RUBRIC]), F.array(*[F.col(s) for s, _, _ in RUBRIC]))
    return folded.select("episode_key", F.lit("r1").alias("reward_id"), (F.col("episode_key") % 50 == 0).alias("tampered"), total.alias("verification"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_key, outputs, verification, verification_evidence, verifier_versions, execution_facts): the maps of a receipt.

    An order without a status of its own leaves out its patch, and one of an even day its termination.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_key"), "o_orderstatus", "o_totalprice", "o_orderdate")
    keep = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    outputs = keep(finding=F.concat(F.lit("f"), F.floor("o_totalprice").cast("long") % 4), patch=F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    facts = keep(os=F.when(F.col("episode_key") % 3 == 0, "darwin").otherwise("linux"), arch=F.when(F.col("episode_key") % 2 == 0, "arm64").otherwise("x86_64"), termination=F.when(F.dayofmonth("o_orderdate") % 2 != 0, "exited"))
    states = episodes(spark, sf_dir).select("episode_key", "verification")
    joined = orders.join(states, "episode_key", "left")
    evidence = F.transform_values(F.map_filter("verification", lambda _, s: s != "not_applicable"), lambda k, s: F.sha2(F.concat(k, F.lit(":"), s, F.lit(":"), (F.col("episode_key") % 5).cast("string")).cast("binary"), 256))
    versions = F.transform_values(F.map_filter("verification", lambda _, s: s != "error"), lambda k, _: F.concat(k, F.lit("@"), (F.col("episode_key") % 2).cast("string")))
    return joined.select("episode_key", outputs.alias("outputs"), "verification", evidence.alias("verification_evidence"), versions.alias("verifier_versions"), facts.alias("execution_facts"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_key, status, validity, reward): reward in hundredths, null where it is not scored."""
    return scoring.score(episodes(spark, sf_dir), rubric(spark), "reward_id").select("episode_key", "status", "validity", "reward")


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_key, candidate_key, episode_key): the newest order of a customer and priority."""
    best = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    ranked = orders.withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    return ranked.select(F.col("o_custkey").alias("task_key"), F.concat(F.lit("c"), F.substring("o_orderpriority", 1, 1)).alias("candidate_key"), F.col("o_orderkey").alias("episode_key"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_key, candidate_key, episode_key, status, reward): the matrix of candidates and tasks."""
    scored = receipts(spark, sf_dir)
    return newest_orders(spark, sf_dir).join(scored, "episode_key", "left").select("task_key", "candidate_key", "episode_key", F.coalesce("status", F.lit("error")).alias("status"), "reward")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot, path, text, doc_id): documents as files of their source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("snapshot"), F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")


def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files as they are found: some gone, some under another path, some changed."""
    extra = files(spark, sf_dir).filter("doc_id % 19 = 0").withColumn("path", F.concat(F.lit("extra/"), "path"))
    there = files(spark, sf_dir).filter("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 23 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return there.union(extra)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot, path, start_line, end_line, quote): one span a file, some of them wrong."""
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n", -1)
    doc = files(spark, sf_dir).filter(F.col("text") != "").withColumn("lines", lines).withColumn("n", F.size("lines"))
    spanned = doc.withColumn("start_line", (F.lit(1) + F.col("doc_id") % F.col("n")).cast("int"))
    spanned = spanned.withColumn("last", F.least(F.col("start_line") + 1, F.col("n")))
    quote = F.array_join(F.slice("lines", F.col("start_line"), F.col("last") - F.col("start_line") + 1), "\n")
    quote = F.when(F.col("doc_id") % 3 == 0, F.concat(quote, F.lit("?"))).otherwise(quote)
    return spanned.select("snapshot", "path", "doc_id", "start_line", F.when(F.col("doc_id") % 7 == 0, F.col("n") + 1).otherwise(F.col("last")).cast("int").alias("end_line"), quote.alias("quote"))


def session_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, key, finishes): a purchase finishes a session."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("key"), (F.col("event_type") == "purchase").alias("finishes"))


def films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(world_key, t, film): the events of a user in order."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("world_key"), F.row_number().over(order).alias("t"), F.col("event_type").alias("film"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(at, label, allowed)"""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.col("event_type").alias("label"), (F.col("value") >= 10).alias("allowed"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(at, key, tier, cost, crystallises): requests as they were resolved."""
    tier = F.col("event_type")
    cost = F.when(tier == "view", 1).when(tier == "click", 2).when(tier == "purchase", 5).otherwise(3)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.get_json_object("props", "$.k").alias("key"), tier.alias("tier"), cost.alias("cost"), (tier == "purchase").alias("crystallises"))


_SQL = {
    "signal_states": ((), """SELECT l_orderkey AS episode_key, concat('s', l_linenumber) AS signal,
  CASE WHEN max(CASE WHEN l_returnflag='N' AND l_linestatus='O' AND l_partkey%8=0 THEN 1 ELSE 0 END)=1 THEN 'error'
       WHEN min(l_returnflag)='A' THEN 'pass' WHEN max(l_returnflag)='R' THEN 'fail' ELSE 'not_applicable' END AS state
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""),
    "rubric": ((), f"SELECT * FROM (VALUES {', '.join(f"('{s}', {w}, {str(r).lower()})" for s, w, r in RUBRIC)}) t(signal, weight, required)"),
    "caps": ((), f"SELECT * FROM (VALUES {', '.join(f"('{s}', '{x}', {m})" for s, x, m in CAPS)}) t(signal, state, reward_max)"),
    "verification": (("signal_states", "rubric"), """SELECT e.episode_key, r.signal, coalesce(s.state, 'fail') AS state, r.weight, r.required
  FROM (SELECT DISTINCT episode_key FROM signal_states) e CROSS JOIN rubric r LEFT JOIN signal_states s ON s.episode_key = e.episode_key AND s.signal = r.signal"""),
    "receipts": (("verification", "caps"), """SELECT episode_key,
  CASE WHEN episode_key % 50 = 0 THEN 'invalid' WHEN bad THEN 'error' WHEN skipped THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN episode_key % 50 = 0 OR bad OR skipped THEN 'invalid' ELSE 'valid' END AS validity,
  CASE WHEN episode_key % 50 = 0 THEN 0 WHEN bad OR skipped THEN NULL ELSE least(raw, coalesce(cap, raw)) END AS reward
  FROM (SELECT v.episode_key, bool_or(v.state = 'error') AS bad, bool_or(v.required AND v.state = 'not_applicable') AS skipped,
    sum(CASE WHEN v.state = 'pass' THEN weight ELSE 0 END)::BIGINT AS raw, min(c.reward_max)::BIGINT AS cap
    FROM verification v LEFT JOIN caps c ON c.signal = v.signal AND c.state = v.state GROUP BY 1)"""),
    "facts": (("verification",), """SELECT o_orderkey AS episode_key, 'outputs' AS field, 'finding' AS key, 'f' || floor(o_totalprice)::BIGINT % 4 AS value FROM orders
  UNION ALL SELECT o_orderkey, 'outputs', 'patch', o_orderstatus FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_orderkey, 'execution_facts', 'os', CASE WHEN o_orderkey % 3 = 0 THEN 'darwin' ELSE 'linux' END FROM orders
  UNION ALL SELECT o_orderkey, 'execution_facts', 'arch', CASE WHEN o_orderkey % 2 = 0 THEN 'arm64' ELSE 'x86_64' END FROM orders
  UNION ALL SELECT o_orderkey, 'execution_facts', 'termination', 'exited' FROM orders WHERE day(o_orderdate) % 2 <> 0
  UNION ALL SELECT episode_key, 'verification', signal, state FROM verification JOIN orders ON o_orderkey = episode_key
  UNION ALL SELECT episode_key, 'verification_evidence', signal, sha256(signal || ':' || state || ':' || episode_key % 5) FROM verification JOIN orders ON o_orderkey = episode_key WHERE state <> 'not_applicable'
  UNION ALL SELECT episode_key, 'verifier_versions', signal, signal || '@' || episode_key % 2 FROM verification JOIN orders ON o_orderkey = episode_key WHERE state <> 'error'"""),
    "newest_orders": ((), """SELECT o_custkey AS task_key, concat('c', o_orderpriority[1]) AS candidate_key, o_orderkey AS episode_key FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""),
    "pairs": (("newest_orders",), """SELECT l.task_key, l.candidate_key AS left_key, r.candidate_key AS right_key, l.episode_key AS l, r.episode_key AS r
  FROM newest_orders l JOIN newest_orders r ON l.task_key = r.task_key AND l.candidate_key < r.candidate_key"""),
    "cells": (("newest_orders", "receipts"), "SELECT task_key, candidate_key, episode_key, coalesce(status, 'error') AS status, reward FROM newest_orders LEFT JOIN receipts USING (episode_key)"),
    "files": ((), "SELECT source AS snapshot, concat(lang, '/', doc_id, '.txt') AS path, coalesce(text, '') AS text, doc_id FROM documents"),
    "drifted": (("files",), """SELECT snapshot, path, CASE WHEN doc_id % 23 = 0 THEN text || '!' ELSE text END AS text, doc_id FROM files WHERE doc_id % 17 <> 0
  UNION ALL SELECT snapshot, 'extra/' || path, text, doc_id FROM files WHERE doc_id % 19 = 0"""),
    "citations": (("files",), """SELECT snapshot, path, doc_id, s AS start_line, CASE WHEN doc_id % 7 = 0 THEN n + 1 ELSE least(s + 1, n) END AS end_line,
  array_to_string(lines[s:least(s + 1, n)], chr(10)) || CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '' END AS quote
  FROM (SELECT *, len(lines) AS n, (1 + doc_id % len(lines))::INT AS s FROM (SELECT *, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM files WHERE text <> ''))"""),
    "session_calls": ((), "SELECT user_id AS session_id, event_id AS seq, props->>'$.k' AS key, event_type = 'purchase' AS finishes FROM events"),
    "films": ((), "SELECT user_id AS world_key, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS t, event_type AS film FROM events"),
    "decisions": ((), "SELECT event_id AS at_, event_type AS label, value >= 10 AS allowed FROM events"),
    "requests": ((), """SELECT event_id AS at_, props->>'$.k' AS key, event_type AS tier,
  CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 5 ELSE 3 END AS cost, event_type = 'purchase' AS crystallises FROM events"""),
}


def sql(body: str, *names: str) -> str:
    """A statement with the named views, and what they need, before its body."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _SQL[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    views = [f"{n} AS ({_SQL[n][1]})" for n in order]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*views, body[5:]])
    return (f"WITH {', '.join(views)} " if views else "") + body
