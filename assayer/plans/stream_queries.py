"""Streams over the events table, run to their end; the batch operators' SQL is their twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.streaming import sessions as S

from . import closure_queries, log_queries
from . import views as V
from .catalog import ORACLES, register
from .views import sql


def _at():
    """The producer's clock: a second for each event."""
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")).alias("at")


def _calls(spark, d):
    return S.table_stream(spark, d, "events").select(F.col("user_id").cast("long").alias("session_id"), F.col("event_id").cast("long").alias("seq"), _at(), F.get_json_object("props", "$.k").alias("key"), (F.col("event_type") == "purchase").alias("finishes"))


@register("str01_submission_admission", "SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS accepted FROM events")
def str01(spark, d):
    where = S.shared_folder(spark)
    docs = S.table_stream(spark, d, "events").select("event_id", F.expr(closure_queries._BODY).alias("body"))
    S.admitted(docs, "event_id", "body", ["submission_version", "finding", "patch"], ["episode_id", "reward", "status"], f"{where}/accepted", f"{where}/refused")
    side = lambda name, ok: S.stored(spark, f"{where}/{name}").select("event_id", F.lit(ok).alias("accepted"))
    return side("accepted", True).union(side("refused", False))


@register("str02_idempotent_scoring", ORACLES["win06_idempotent_retry"])
def str02(spark, d):
    where = S.shared_folder(spark)
    S.drained(S.retries(_calls(spark, d)), S.kept(where, S.new_run()))
    return S.stored(spark, where).drop("run", "batch")


@register("str03_session_lifecycle", ORACLES["win05_session_transitions"])
def str03(spark, d):
    where = S.shared_folder(spark)
    events = S.table_stream(spark, d, "events")
    actions = events.select((F.col("user_id") * 1000 + F.col("event_id") % 8).cast("long").alias("session_id"), F.col("event_id").cast("long").alias("seq"), _at(), F.expr(log_queries.ACTION).alias("action"))
    S.drained(S.lifecycle(actions), S.kept(where, S.new_run()))
    return S.stored(spark, where).drop("run", "batch")


@register("str04_exactly_once_publish", """SELECT DISTINCT id, content, content <> low AS conflict FROM (SELECT *, min(content) OVER (PARTITION BY id) AS low FROM (
SELECT 'trace-' || sha256(user_id || ':' || CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END) AS id, user_id || ':' || event_type AS content FROM events))""")
def str04(spark, d):
    where = S.shared_folder(spark)
    content = F.concat_ws(":", "user_id", "event_type")
    named = F.concat_ws(":", "user_id", F.when(F.col("event_type") == "error", "view").otherwise(F.col("event_type")))  # an error takes the id of a view
    rows = S.table_stream(spark, d, "events").select(F.concat(F.lit("trace-"), F.sha2(named.cast("binary"), 256)).alias("id"), content.alias("content"))
    for _ in range(2):  # a second run adds nothing
        S.published(rows, f"{where}/published", f"{where}/conflicts", f"{where}/checkpoint")
    found = S.stored(spark, f"{where}/published").select("id", "content", F.lit(False).alias("conflict"))
    return found.union(S.stored(spark, f"{where}/conflicts").select("id", "content", F.lit(True)).distinct())


@register("str05_running_totals", """SELECT split, count(*) AS tasks, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'invalid') AS n_invalid, count(*) FILTER (status = 'error') AS n_error,
count(reward) AS scored, coalesce(sum(reward), 0)::BIGINT AS reward_sum, avg(reward) AS reward_mean
FROM (SELECT user_id % 8 AS split, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'invalid' ELSE 'error' END AS status, CASE WHEN event_type = 'purchase' THEN event_id % 101 END AS reward FROM events) GROUP BY 1""")
def str05(spark, d):
    where = S.shared_folder(spark)
    status = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "click", "invalid").otherwise("error")
    rows = S.table_stream(spark, d, "events").select((F.col("user_id") % 8).alias("split"), status.alias("status"), F.when(F.col("event_type") == "purchase", F.col("event_id") % 101).alias("reward"))
    run = S.new_run()
    S.drained(S.running_totals(rows, "split"), S.upserts(where, ["split"], run), "update")
    return S.latest(spark, where, ["split"], run)


@register("str06_gate_counters", ORACLES["agg23_gate_counts"])
def str06(spark, d):
    where = S.shared_folder(spark)
    rows = S.table_stream(spark, d, "events").select(F.col("event_type").alias("label"), (F.col("value") >= 10).alias("allowed"))
    run = S.new_run()
    S.drained(S.counters(rows), S.upserts(where, ["label"], run), "update")
    return S.latest(spark, where, ["label"], run)
