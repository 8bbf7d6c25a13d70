"""Scoring: rubric weights, caps, precedence, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.functions import identity
from assayer.operators import scoring

from . import views as V
from .catalog import register
from .views import sql


@register("agg01_score", sql("SELECT episode_key, status, validity, reward FROM receipts", "receipts"))
def agg01(spark, d):
    return V.receipts(spark, d)


@register("agg02_score_input_check", sql("""
SELECT episode_key, signal, 'missing_signal' AS code FROM (SELECT DISTINCT episode_key FROM signal_states) e CROSS JOIN rubric r
WHERE NOT EXISTS (SELECT 1 FROM signal_states s WHERE s.episode_key = e.episode_key AND s.signal = r.signal)
UNION ALL SELECT episode_key, signal, 'unknown_state' FROM signal_states WHERE state NOT IN ('pass', 'fail', 'error')""", "signal_states", "rubric"))
def agg02(spark, d):
    wanted = spark.createDataFrame([(s,) for s, _, _ in V.RUBRIC], "signal string")
    return scoring.score_violations(V.signal_states(spark, d), wanted, "episode_key", ("pass", "fail", "error"))


_TOTALS = """count(*) AS tasks, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'invalid') AS n_invalid,
count(*) FILTER (status = 'error') AS n_error, count(reward) AS scored, coalesce(sum(reward), 0)::BIGINT AS reward_sum, avg(reward) AS reward_mean"""


@register("agg03_split_totals", sql(f"SELECT task_key % 8 AS split, {_TOTALS} FROM cells GROUP BY 1", "cells"))
def agg03(spark, d):
    return scoring.totals(V.cells(spark, d).withColumn("split", F.col("task_key") % 8), "split")


@register("agg04_aggregation_profile", sql("SELECT 'excluded' AS unscored_policy, count(reward) AS scored, count(*) - count(reward) AS unscored FROM receipts", "receipts"))
def agg04(spark, d):
    return V.receipts(spark, d).agg(F.lit("excluded").alias("unscored_policy"), F.count("reward").alias("scored"), (F.count(F.lit(1)) - F.count("reward")).alias("unscored"))


@register("jn07_signal_weights", sql("SELECT episode_key, signal, state, CASE WHEN state = 'pass' THEN weight END AS weight FROM verification WHERE required OR state = 'pass'", "verification"))
def jn07(spark, d):
    weights = F.broadcast(spark.createDataFrame(list(V.RUBRIC), "signal string, w int, required boolean"))
    states = V.episodes(spark, d).select("episode_key", F.explode("verification").alias("signal", "state"))
    return states.join(weights, "signal", "left").filter("required or state = 'pass'").select("episode_key", "signal", "state", F.when(F.col("state") == "pass", F.col("w")).alias("weight"))


@register("jn08_cap_triggers", sql("SELECT episode_key, min(reward_max) AS cap, count(*) AS triggered FROM verification JOIN caps USING (signal, state) GROUP BY 1", "verification", "caps"))
def jn08(spark, d):
    caps = F.broadcast(spark.createDataFrame(list(V.CAPS), "signal string, state string, reward_max int"))
    states = V.episodes(spark, d).select("episode_key", F.explode("verification").alias("signal", "state"))
    return states.join(caps, ["signal", "state"]).groupBy("episode_key").agg(F.min("reward_max").alias("cap"), F.count(F.lit(1)).alias("triggered"))


@register("srt05_lowest_cap", sql("SELECT episode_key, signal, reward_max FROM verification JOIN caps USING (signal, state) QUALIFY row_number() OVER (PARTITION BY episode_key ORDER BY reward_max, signal) = 1", "verification", "caps"))
def srt05(spark, d):
    caps = F.broadcast(spark.createDataFrame(list(V.CAPS), "signal string, state string, reward_max int"))
    states = V.episodes(spark, d).select("episode_key", F.explode("verification").alias("signal", "state"))
    low = F.min(F.struct("reward_max", "signal")).alias("low")
    return states.join(caps, ["signal", "state"]).groupBy("episode_key").agg(low).select("episode_key", "low.signal", "low.reward_max")


@register("flt08_scored_rows", sql("SELECT episode_key, reward FROM receipts WHERE reward IS NOT NULL", "receipts"))
def flt08(spark, d):
    return V.receipts(spark, d).filter("reward is not null").select("episode_key", "reward")


@register("set01_evidence_signals", sql("""
SELECT s.episode_key, array_to_string(list_sort(list_distinct(list(signal))), ',') AS signals FROM (
  SELECT episode_key, signal FROM signal_states WHERE state <> 'not_applicable' UNION SELECT episode_key, signal FROM (SELECT DISTINCT episode_key FROM signal_states), (SELECT signal FROM rubric WHERE required)
) s WHERE signal <> 's5' GROUP BY 1""", "signal_states", "rubric"))
def set01(spark, d):
    states = V.signal_states(spark, d)
    required = F.array(*[F.lit(s) for s, _, r in V.RUBRIC if r])
    per = states.groupBy("episode_key").agg(F.collect_set(F.when(F.col("state") != "not_applicable", F.col("signal"))).alias("seen"))
    return per.select("episode_key", F.array_join(F.array_sort(F.array_except(F.array_union("seen", required), F.array(F.lit("s5")))), ",").alias("signals"))


@register("set02_total_keys", sql("""
SELECT e.episode_key, k.signal, coalesce(s.state, 'not_applicable') AS state FROM (SELECT DISTINCT episode_key FROM signal_states) e
CROSS JOIN (SELECT signal FROM rubric UNION SELECT unnest(['native', 'oracle'])) k LEFT JOIN signal_states s ON s.episode_key = e.episode_key AND s.signal = k.signal""", "signal_states", "rubric"))
def set02(spark, d):
    keys = F.array(*[F.lit(s) for s in [*(s for s, _, _ in V.RUBRIC), *C.PSEUDO_SIGNALS]])
    per = V.signal_states(spark, d).groupBy("episode_key").agg(F.map_from_entries(F.collect_list(F.struct("signal", "state"))).alias("seen"))
    return per.select("episode_key", "seen", F.explode(keys).alias("signal")).select("episode_key", "signal", F.coalesce(F.try_element_at("seen", F.col("signal")), F.lit("not_applicable")).alias("state"))


@register("flt07_non_pseudo_signals", sql("SELECT episode_key, signal FROM signal_states WHERE signal NOT IN ('s4', 's5')", "signal_states"))
def flt07(spark, d):
    return V.signal_states(spark, d).filter(~F.col("signal").isin("s4", "s5")).select("episode_key", "signal")


@register("set04_plan_overlap", sql("""
SELECT task_key, candidate_key, array_to_string(list_sort(list_intersect(['s1', 's2'], na)), ',') AS overlap FROM newest_orders JOIN
(SELECT episode_key, list(signal) AS na FROM signal_states WHERE state = 'not_applicable' GROUP BY 1) USING (episode_key) WHERE len(list_intersect(['s1', 's2'], na)) > 0""", "newest_orders", "signal_states"))
def set04(spark, d):
    na = V.signal_states(spark, d).filter("state = 'not_applicable'").groupBy("episode_key").agg(F.collect_set("signal").alias("na"))
    overlap = F.array_sort(F.array_intersect(F.array(F.lit("s1"), F.lit("s2")), "na"))
    return V.newest_orders(spark, d).join(na, "episode_key").filter(F.size(overlap) > 0).select("task_key", "candidate_key", F.array_join(overlap, ",").alias("overlap"))


@register("set05_unanswerable", sql("""
SELECT e.episode_key, string_agg(r.signal, ',' ORDER BY r.signal) AS missing FROM (SELECT DISTINCT episode_key FROM signal_states) e CROSS JOIN (SELECT signal FROM rubric WHERE required) r
WHERE NOT EXISTS (SELECT 1 FROM signal_states s WHERE s.episode_key = e.episode_key AND s.signal = r.signal) GROUP BY 1""", "signal_states", "rubric"))
def set05(spark, d):
    required = F.array(*[F.lit(s) for s, _, r in V.RUBRIC if r])
    per = V.signal_states(spark, d).groupBy("episode_key").agg(F.collect_set("signal").alias("has"))
    return per.select("episode_key", F.array_join(F.array_sort(F.array_except(required, "has")), ",").alias("missing")).filter("missing <> ''")


@register("set06_key_set_equality", sql("SELECT episode_key, list_sort(list(signal)) = (SELECT list_sort(list(signal)) FROM rubric) AS equal FROM signal_states GROUP BY 1", "signal_states", "rubric"))
def set06(spark, d):
    keys = F.array(*[F.lit(s) for s, _, _ in V.RUBRIC])
    return V.signal_states(spark, d).groupBy("episode_key").agg((F.array_sort(F.collect_set("signal")) == keys).alias("equal"))


@register("sca12_run_error_override", sql("SELECT episode_key, signal, CASE WHEN episode_key % 11 = 0 AND signal <> 'native' THEN 'error' ELSE state END AS state FROM (SELECT episode_key, signal, state FROM verification UNION ALL SELECT DISTINCT episode_key, 'native', 'pass' FROM verification)", "verification"))
def sca12(spark, d):
    states = F.map_concat("verification", F.create_map(F.lit("native"), F.lit("pass")))
    return V.episodes(spark, d).select("episode_key", F.explode(C.overridden(states, F.col("episode_key") % 11 == 0)).alias("signal", "state"))


@register("sca13_tampered", sql("SELECT episode_key, count(*) FILTER (state = 'error') > 0 AS tampered FROM verification GROUP BY 1", "verification"))
def sca13(spark, d):
    return V.episodes(spark, d).select("episode_key", (F.size(F.filter(F.map_values("verification"), lambda s: s == "error")) > 0).alias("tampered"))


@register("sca17_evidence_digest", sql("""SELECT episode_key, signal, 'sha256:' || sha256('{"detail":' || CASE WHEN episode_key % 3 = 0 THEN '{}' ELSE '{"codes":[0,1.5,null],"key":' || episode_key || ',"é":{"a":1,"b":"x"}}' END || ',"evidence_version":"v1","signal":"' || signal || '","state":"' || state || '"}') AS digest FROM signal_states""", "signal_states"))
def sca17(spark, d):
    detail = F.when(F.col("episode_key") % 3 != 0, F.concat(F.lit('{"é": {"b": "x", "a": 1}, "key": '), F.col("episode_key").cast("string"), F.lit(', "codes": [0, 1.50, null]}')))
    return V.signal_states(spark, d).select("episode_key", "signal", identity.evidence_digest(F.col("signal"), F.col("state"), detail, "v1").alias("digest"))


# What an evaluation asked to keep and what became of it, beside what it scored.
_KEPT = """SELECT *, CASE WHEN episode_key % 13 = 0 THEN 'not_requested' WHEN status = 'error' THEN 'unavailable' WHEN episode_key % 17 = 0 OR episode_key % 19 = 0 THEN 'error' ELSE 'closed' END AS persistence,
CASE WHEN episode_key % 13 = 0 THEN NULL WHEN status = 'error' THEN 'no_episode' WHEN episode_key % 17 = 0 THEN 'no_artifacts' WHEN episode_key % 19 = 0 THEN 'write_failed' END AS reason FROM cells"""


def _kept(spark, d):
    key = F.col("episode_key")
    return V.cells(spark, d).withColumn("_kept", scoring.persistence(key % 13 != 0, F.col("status") != "error", key % 17 != 0, key % 19 != 0)).select("*", "_kept.*").drop("_kept")


@register("agg22_run_grade", sql(f"SELECT task_key AS split, CASE WHEN bool_or(persistence = 'error') THEN 2 WHEN bool_or(status <> 'ok') THEN 1 ELSE 0 END AS grade FROM ({_KEPT}) GROUP BY 1", "cells"))
def agg22(spark, d):
    return scoring.run_grade(_kept(spark, d).withColumnRenamed("task_key", "split"), "split")


@register("agg29_persistence_states", sql(f"SELECT candidate_key, persistence, reason, count(*) AS n FROM ({_KEPT}) GROUP BY ALL", "cells"))
def agg29(spark, d):
    return _kept(spark, d).groupBy("candidate_key", "persistence", "reason").agg(F.count(F.lit(1)).alias("n"))
