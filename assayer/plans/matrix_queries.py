"""The matrix of candidates and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.operators import closure, matrix, scoring

from . import views as V
from .catalog import register
from .views import sql

_PAIRS = """SELECT l.task_key, l.candidate_key AS left_key, r.candidate_key AS right_key, l.episode_key AS left_episode, r.episode_key AS right_episode, l.reward AS lr, r.reward AS rr, l.status AS ls, r.status AS rs
FROM cells l JOIN cells r ON l.task_key = r.task_key AND l.candidate_key < r.candidate_key"""
_RELATION = "CASE WHEN lr IS NULL OR rr IS NULL THEN 'incomparable' WHEN lr > rr THEN 'left_higher' WHEN rr > lr THEN 'right_higher' ELSE 'equal' END"


@register("jn11_candidate_pairs", sql(f"SELECT task_key, left_key, right_key, left_episode, right_episode FROM ({_PAIRS})", "cells"))
def jn11(spark, d):
    return matrix.pairs(V.cells(spark, d)).select("task_key", F.col("left.candidate_key").alias("left_key"), F.col("right.candidate_key").alias("right_key"), F.col("left.episode_key").alias("left_episode"), F.col("right.episode_key").alias("right_episode"))


@register("sca14_reward_relation", sql(f"SELECT left_key, right_key, {_RELATION} AS relation, count(*) AS n, sum(rr - lr)::BIGINT AS delta_sum FROM ({_PAIRS}) GROUP BY ALL", "cells"))
def sca14(spark, d):
    compared = matrix.compared(matrix.pairs(V.cells(spark, d)))
    return compared.groupBy(F.col("left.candidate_key").alias("left_key"), F.col("right.candidate_key").alias("right_key"), "relation").agg(F.count(F.lit(1)).alias("n"), F.sum("right_minus_left").alias("delta_sum"))


@register("sca15_same_flags", sql(f"SELECT task_key, left_key, right_key, lr IS NOT DISTINCT FROM rr AS same_reward, ls = rs AS same_status, left_episode = right_episode AS same_episode FROM ({_PAIRS})", "cells"))
def sca15(spark, d):
    same = lambda f: F.col(f"left.{f}").eqNullSafe(F.col(f"right.{f}"))
    return matrix.pairs(V.cells(spark, d)).select("task_key", F.col("left.candidate_key").alias("left_key"), F.col("right.candidate_key").alias("right_key"), same("reward").alias("same_reward"), same("status").alias("same_status"), same("episode_key").alias("same_episode"))


@register("sca20_pair_member", sql(f"SELECT 'comparisons/' || task_key || '/' || left_key || '--' || right_key || '.json' AS member FROM ({_PAIRS})", "cells"))
def sca20(spark, d):
    return matrix.pairs(V.cells(spark, d)).select(C.pair_member(F.col("task_key"), F.col("left.candidate_key"), F.col("right.candidate_key")).alias("member"))


@register("prj04_side_projection", sql(f"SELECT task_key, left_key, ls AS left_status, lr AS left_reward, right_key, rs AS right_status, rr AS right_reward FROM ({_PAIRS})", "cells"))
def prj04(spark, d):
    return matrix.pairs(V.cells(spark, d)).select("task_key", *[F.col(f"{s}.{f}").alias(f"{s}_{g}") for s in ("left", "right") for f, g in (("candidate_key", "key"), ("status", "status"), ("reward", "reward"))])


@register("jn12_pair_refusals", sql("""
SELECT t.task_key, l.k AS left_key, r.k AS right_key, concat_ws(',', CASE WHEN a.reward IS NULL THEN l.k END, CASE WHEN b.reward IS NULL THEN r.k END) AS missing
FROM (SELECT DISTINCT task_key FROM cells) t CROSS JOIN (SELECT DISTINCT candidate_key AS k FROM cells) l JOIN (SELECT DISTINCT candidate_key AS k FROM cells) r ON l.k < r.k
LEFT JOIN cells a ON a.task_key = t.task_key AND a.candidate_key = l.k LEFT JOIN cells b ON b.task_key = t.task_key AND b.candidate_key = r.k
WHERE a.reward IS NULL OR b.reward IS NULL""", "cells"))
def jn12(spark, d):
    cells = V.cells(spark, d)
    return matrix.grid_refusals(cells, cells.select("candidate_key").distinct())


@register("jn13_same_task_guard", sql("""SELECT l.episode_key AS left_key, r.episode_key AS right_key, l.task_key AS left_task, r.task_key AS right_task, 'TASK_MISMATCH' AS code
FROM newest_orders l JOIN newest_orders r ON r.episode_key = l.episode_key + 1 WHERE l.task_key IS DISTINCT FROM r.task_key""", "newest_orders"))
def jn13(spark, d):
    orders = V.newest_orders(spark, d)
    return matrix.same_task(orders.select(F.col("episode_key").alias("left_key"), (F.col("episode_key") + 1).alias("right_key")), orders)


@register("jn14_receipt_diff", sql("""SELECT task_key, left_key, right_key, field, key, a.value AS "left", b.value AS "right"
FROM (SELECT p.task_key, p.left_key, p.right_key, f.field, f.key, f.value FROM pairs p JOIN facts f ON f.episode_key = p.l) a FULL JOIN (SELECT p.task_key, p.left_key, p.right_key, f.field, f.key, f.value FROM pairs p JOIN facts f ON f.episode_key = p.r) b
USING (task_key, left_key, right_key, field, key) WHERE a.value IS DISTINCT FROM b.value""", "pairs", "facts"))
def jn14(spark, d):
    fields = ("outputs", "verification", "verification_evidence", "verifier_versions", "execution_facts")
    cells = V.newest_orders(spark, d).join(V.records(spark, d), "episode_key", "left")
    both = matrix.pairs(cells, fields=("candidate_key", *fields))
    found = F.explode(matrix.field_differences(F.col("left"), F.col("right"), fields)).alias("x")
    return both.select("task_key", F.col("left.candidate_key").alias("left_key"), F.col("right.candidate_key").alias("right_key"), found).select("task_key", "left_key", "right_key", "x.*")


@register("agg05_batch_totals", sql(f"""SELECT (SELECT count(DISTINCT candidate_key) FROM cells) AS candidates, (SELECT count(DISTINCT task_key) FROM cells) AS tasks, (SELECT count(*) FROM cells) AS episodes,
(SELECT count(reward) FROM cells) AS scored, (SELECT count(*) FROM ({_PAIRS}) WHERE lr IS NOT NULL AND rr IS NOT NULL) AS comparisons, (SELECT count(*) FROM ({_PAIRS}) WHERE lr IS NULL OR rr IS NULL) AS refusals""", "cells"))
def agg05(spark, d):
    return matrix.batch_totals(V.cells(spark, d))


@register("agg06_candidate_row", sql("SELECT candidate_key, row_number() OVER (PARTITION BY candidate_key ORDER BY task_key, episode_key) AS pos, task_key, episode_key FROM cells", "cells"))
def agg06(spark, d):
    return matrix.candidate_rows(V.cells(spark, d))


@register("agg06_candidate_totals", sql("SELECT candidate_key, count(*) AS tasks, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'invalid') AS n_invalid, count(*) FILTER (status = 'error') AS n_error, count(reward) AS scored, coalesce(sum(reward), 0)::BIGINT AS reward_sum, avg(reward) AS reward_mean FROM cells GROUP BY 1", "cells"))
def agg06_totals(spark, d):
    return scoring.totals(V.cells(spark, d), "candidate_key")


@register("agg07_matrix", sql("SELECT task_key, " + ", ".join(f"min(CASE WHEN candidate_key = 'c{i}' THEN reward END) AS c{i}" for i in range(1, 6)) + " FROM cells GROUP BY 1", "cells"))
def agg07(spark, d):
    return matrix.wide(V.cells(spark, d), [f"c{i}" for i in range(1, 6)])


@register("win02_one_per_cell", "SELECT o_custkey AS task_key, concat('c', o_orderpriority[1]) AS candidate_key, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def win02(spark, d):
    return matrix.one_per_cell(V.table(spark, d, "orders").select(F.col("o_custkey").alias("task_key"), F.concat(F.lit("c"), F.substring("o_orderpriority", 1, 1)).alias("candidate_key")))


@register("win02_newest_episode", sql("SELECT * FROM newest_orders", "newest_orders"))
def win02_newest(spark, d):
    return V.newest_orders(spark, d)


@register("agg27_duplicates", "SELECT o_custkey AS owner, o_orderpriority AS member, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def agg27(spark, d):
    return V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("member")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@register("srt01_task_order", sql("SELECT task_key, row_number() OVER (ORDER BY task_key) AS pos FROM (SELECT task_key FROM cells GROUP BY 1)", "cells"))
def srt01(spark, d):
    return matrix.numbered(V.cells(spark, d).select("task_key").distinct(), "task_key")


@register("srt02_candidate_order", sql("SELECT candidate_key, count(*) AS n FROM cells GROUP BY 1 ORDER BY 1", "cells"))
def srt02(spark, d):
    return V.cells(spark, d).groupBy("candidate_key").agg(F.count(F.lit(1)).alias("n")).orderBy("candidate_key")


@register("srt03_first_n", sql("SELECT task_key, candidate_key, reward FROM cells WHERE reward IS NOT NULL ORDER BY reward DESC, task_key, candidate_key LIMIT 20", "cells"))
def srt03(spark, d):
    return V.cells(spark, d).filter("reward is not null").select("task_key", "candidate_key", "reward").orderBy(F.desc("reward"), "task_key", "candidate_key").limit(20)


@register("flt06_candidate_key", "SELECT doc_id, doc_id % 4 = 3 AND regexp_full_match(source || '-' || lang, '[A-Za-z0-9][A-Za-z0-9_.-]{0,63}') AS valid FROM documents")
def flt06(spark, d):
    key = F.concat_ws("-", "source", "lang")
    key = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("-"), key)).when(F.col("doc_id") % 4 == 1, F.concat(key, F.lit("--x"))).when(F.col("doc_id") % 4 == 2, F.concat(key, F.repeat(F.lit("x"), 64))).otherwise(key)
    return V.table(spark, d, "documents").select("doc_id", C.candidate_key(key).alias("valid"))


@register("flt05_signal_id", "SELECT event_id, event_id % 5 = 4 AS valid FROM events")
def flt05(spark, d):
    name = F.concat("event_type", "event_id")
    turn = F.col("event_id") % 5
    name = F.when(turn == 0, F.upper(name)).when(turn == 1, F.concat(F.lit("_"), name)).when(turn == 2, F.concat(name, F.lit("\n"))).when(turn == 3, F.concat(name, F.repeat(F.lit("x"), 64))).otherwise(name)
    return V.table(spark, d, "events").select("event_id", C.signal_id(name).alias("valid"))


@register("jn25_shared_subject", """SELECT c_custkey AS task_key, c_nationkey AS split, CASE WHEN n_regionkey <> 4 THEN 'snap-' || sha256('{"name":"' || n_name || '","region":' || n_regionkey || '}') END AS snapshot_id,
CASE WHEN n_regionkey IS NULL OR n_regionkey = 4 THEN 'SUBJECT_MISSING' END AS code FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def jn25(spark, d):
    """Customers are tasks, their nation is the split; a nation's record is the tree that its tasks share."""
    tasks = V.table(spark, d, "customer").select(F.col("c_custkey").alias("task_key"), F.col("c_nationkey").alias("split"))
    record = C.canonical_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    subjects = V.table(spark, d, "nation").filter("n_regionkey <> 4").select(F.col("n_nationkey").alias("split"), C.content_id("snap", record).alias("snapshot_id"))
    return closure.with_subject(tasks, subjects, "split")
