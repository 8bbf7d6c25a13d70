"""Films, decision and route logs, sessions and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.operators import films, logs

from . import views as V
from .catalog import register
from .views import sql

# The next user's film, or for some users their own again.
_NEXT = """SELECT coalesce(l.world_key, r.world_key) AS world_key, coalesce(l.t, r.t) AS t, l.film IS NOT DISTINCT FROM r.film AS same FROM (SELECT * FROM films WHERE world_key % 2 = 0) l
FULL JOIN (SELECT world_key - 1 AS world_key, t, film FROM films WHERE world_key % 2 = 1 AND world_key % 10 <> 1 UNION ALL SELECT * FROM films WHERE world_key % 10 = 0) r ON l.world_key = r.world_key AND l.t = r.t"""


def _both(spark, d):
    rows, key = V.films(spark, d), F.col("world_key")
    other = rows.filter((key % 2 == 1) & (key % 10 != 1)).withColumn("world_key", key - 1).union(rows.filter(key % 10 == 0))
    return rows.filter(key % 2 == 0), other


@register("jn15_film_diff", sql(_NEXT, "films"))
def jn15(spark, d):
    return films.compared(*_both(spark, d), "world_key")


@register("agg20_first_divergence", sql(f"SELECT world_key, min(t) FILTER (NOT same) AS first_divergence, max(t) AS epochs, bool_and(same) AS identical FROM ({_NEXT}) GROUP BY 1", "films"))
def agg20(spark, d):
    return films.divergence(*_both(spark, d), "world_key")


@register("win09_final_film", sql("SELECT world_key, max_by(film, t) AS film FROM films GROUP BY 1", "films"))
def win09(spark, d):
    return films.final(V.films(spark, d), "world_key")


@register("agg21_reproduced", sql("SELECT world_key, max_by(film, t) = CASE WHEN world_key % 3 = 0 THEN NULL WHEN world_key % 3 = 1 THEN 'view' ELSE 'click' END AS reproduced FROM films GROUP BY 1", "films"))
def agg21(spark, d):
    pins = V.films(spark, d).select("world_key").distinct().withColumn("pinned", F.when(F.col("world_key") % 3 == 1, "view").when(F.col("world_key") % 3 == 2, "click"))
    return films.reproduced(V.films(spark, d), pins, "world_key")


@register("agg19_verifier_agreement", """SELECT user_id % 10 AS verifier, count(*) FILTER (o = 'agreed') AS agreed, count(*) FILTER (o = 'disagreed') AS disagreed, count(*) FILTER (o = 'unavailable') AS unavailable,
count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o <> 'skipped') AS total FROM (SELECT user_id, CASE WHEN event_id % 13 = 0 THEN 'skipped' WHEN event_id % 11 = 0 THEN 'unavailable' WHEN value >= 10 THEN 'agreed' ELSE 'disagreed' END AS o FROM events) GROUP BY 1""")
def agg19(spark, d):
    outcome = F.when(F.col("event_id") % 13 == 0, "skipped").when(F.col("event_id") % 11 == 0, "unavailable").when(F.col("value") >= 10, "agreed").otherwise("disagreed")
    return films.agreement(V.table(spark, d, "events").select((F.col("user_id") % 10).alias("verifier"), outcome.alias("outcome")), "verifier")


@register("agg23_gate_counts", sql("SELECT label, count(*) FILTER (allowed) AS allow, count(*) FILTER (NOT allowed) AS refuse, count(*) AS total FROM decisions GROUP BY 1", "decisions"))
def agg23(spark, d):
    return logs.gate_counts(V.decisions(spark, d), "label")


@register("agg24_routes_by_tier", sql("SELECT CASE WHEN at_ % 20 = 0 THEN 'refused' WHEN at_ % 20 = 1 THEN 'escalate' WHEN at_ % 20 = 2 THEN 'none' ELSE tier END AS tier, count(*) AS n, sum(CASE WHEN at_ % 20 < 3 THEN 0 ELSE cost END)::BIGINT AS cost FROM requests GROUP BY 1", "requests"))
def agg24(spark, d):
    at = F.col("at") % 20
    rows = V.requests(spark, d).select(F.when(at >= 3, F.col("tier")).alias("tier"), (at == 0).alias("refused"), (at == 1).alias("escalated"), F.when(at >= 3, F.col("cost")).alias("cost"))
    return logs.routes_by_tier(rows)


@register("agg25_result_tally", """SELECT 'u' || user_id AS log, count(*) FILTER (event_id % 3 = 0) AS pass, count(*) FILTER (event_id % 3 = 1 AND user_id % 4 <> 0) AS fail, count(*) FILTER (event_id % 3 = 2 AND event_id % 2 = 0) AS skip,
user_id % 3 <> 0 AND count(*) FILTER (event_id % 3 = 1 AND user_id % 4 <> 0) = 0 AS crashed FROM events GROUP BY user_id UNION ALL SELECT 'r' || r_regionkey, 0, 0, 0, r_regionkey > 1 FROM region""")
def agg25(spark, d):
    """A log of each user's events, and logs without lines; some runs ended with an error code."""
    line = F.concat(F.expr("CASE event_id % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN CASE WHEN user_id % 4 <> 0 THEN 'FAIL' ELSE ' FAIL' END ELSE CASE event_id % 2 WHEN 0 THEN 'SKIP' ELSE 'SKIPPED' END END"), F.lit(" test_"), "event_id")
    rows = V.table(spark, d, "events")
    codes = rows.select(F.concat(F.lit("u"), "user_id").alias("log"), (F.col("user_id") % 3).alias("code")).distinct().union(V.table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.when(F.col("r_regionkey") > 1, 1).otherwise(0)))
    return logs.result_tally(rows.select(F.concat(F.lit("u"), "user_id").alias("log"), line.alias("line")), "log", "line", codes)


@register("agg26_count", "SELECT count(*) AS n FROM events")
def agg26(spark, d):
    return V.table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"))


@register("flt03_where", "SELECT event_id FROM events WHERE event_type = 'click' AND (props->>'$.k') IS DISTINCT FROM '1' AND value <> 0 AND floor(value) <> 20")
def flt03(spark, d):
    rows = V.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("whole", F.floor("value").cast("double"))
    return logs.where(rows, "event_type=click", "k!=1", "value", "whole!=20", "none!=20", "none=undefined").select("event_id")


@register("flt03_where_truthy", "SELECT event_id, 'k' AS field FROM events WHERE (props->>'$.k') <> '' UNION ALL SELECT event_id, 'zero' FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'part' FROM events WHERE event_id % 8 = 1")
def flt03_truthy(spark, d):
    """Strings such as 0 are true, doubles of zero are not, and doubles are compared as they are written."""
    rows = V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), (F.col("event_id") % 3).cast("double").alias("zero"), ((F.col("event_id") % 8) / 8).alias("part"))
    return logs.where(rows, "k").select("event_id", F.lit("k").alias("field")).union(logs.where(rows, "zero").select("event_id", F.lit("zero"))).union(logs.where(rows, "part=0.125").select("event_id", F.lit("part")))


@register("prj05_field_map", "SELECT event_id, props->>'$.k' AS k FROM events")
def prj05(spark, d):
    return V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@register("sca21_request_key", "SELECT event_id, event_type || '::{\"u\":' || user_id || '}' AS key FROM events")
def sca21(spark, d):
    return V.table(spark, d, "events").select("event_id", C.request_key(F.col("event_type"), F.struct(F.col("user_id").alias("u"))).alias("key"))


@register("sca26_gate_verdict", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'no-admissible' WHEN 2 THEN 'parse-error' WHEN 3 THEN 'escalation' ELSE 'error' END AS verdict,
CASE WHEN event_id % 7 = 0 THEN event_id % 2 = 0 ELSE event_id % 5 = 0 END AS allowed FROM events""")
def sca26(spark, d):
    e = F.col("event_id")
    return V.table(spark, d, "events").select("event_id", C.gate_verdict(e % 5).alias("verdict"), C.gate_allows(e % 7 != 0, e % 2 != 0, e % 5).alias("allowed"))


ACTION = "CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'finalize' WHEN 'purchase' THEN 'finalized' WHEN 'error' THEN 'finalize_failed' ELSE 'close' END"


@register("win05_session_transitions", f"""WITH e AS (SELECT user_id * 1000 + event_id % 8 AS session_id, event_id AS seq, {ACTION} AS action FROM events),
s AS (SELECT session_id, min(seq) AS started FROM e WHERE action = 'start' GROUP BY 1),
f AS (SELECT session_id, min(seq) FILTER (action = 'finalize') AS fin, min(seq) FILTER (action = 'close') AS clo FROM e JOIN s USING (session_id) WHERE seq > started GROUP BY 1),
c AS (SELECT session_id, started, CASE WHEN fin < coalesce(clo, fin + 1) THEN fin END AS claimed, CASE WHEN clo < coalesce(fin, clo + 1) THEN clo END AS early FROM s LEFT JOIN f USING (session_id)),
d AS (SELECT session_id, min(seq) AS settled, min_by(action, seq) AS outcome FROM e JOIN c USING (session_id) WHERE seq > claimed AND action IN ('finalized', 'finalize_failed') GROUP BY 1),
l AS (SELECT session_id, min(seq) AS late FROM e JOIN d USING (session_id) WHERE seq > settled AND action = 'close' GROUP BY 1),
x AS (SELECT e.*, coalesce(seq > started, false) AS st, coalesce(seq > claimed, false) AS cl, coalesce(seq > settled, false) AS se, coalesce(seq > early, false) OR coalesce(seq > late, false) AS gone, outcome
  FROM e LEFT JOIN c USING (session_id) LEFT JOIN d USING (session_id) LEFT JOIN l USING (session_id))
SELECT session_id, seq, action, CASE WHEN NOT st THEN 'none' WHEN gone THEN 'closed' WHEN se THEN outcome WHEN cl THEN 'finalizing' ELSE 'started' END AS state,
CASE WHEN action = 'start' THEN CASE WHEN st THEN 'SESSION_STATE' ELSE 'accepted' END WHEN gone OR NOT st THEN CASE WHEN action = 'close' THEN 'nothing' ELSE 'SESSION_UNKNOWN' END
WHEN action = 'finalize' THEN CASE WHEN cl THEN 'SESSION_STATE' ELSE 'accepted' END WHEN action = 'close' THEN CASE WHEN cl AND NOT se THEN 'SESSION_BUSY' ELSE 'accepted' END
ELSE CASE WHEN cl AND NOT se THEN 'accepted' ELSE 'SESSION_STATE' END END AS answer FROM x""")
def win05(spark, d):
    """Events of a user are dealt out to eight sessions each."""
    e = V.table(spark, d, "events")
    return logs.session_answers(e.select((F.col("user_id") * 1000 + F.col("event_id") % 8).alias("session_id"), F.col("event_id").alias("seq"), F.expr(ACTION).alias("action")))


@register("win05_illegal_steps", "SELECT conv_id AS session_id, turn AS seq, b AS before, role AS state FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations) WHERE b IS NOT NULL AND NOT (b = 'user' AND role = 'assistant') AND NOT (b = 'system' AND role = 'user')")
def win05_steps(spark, d):
    """Turns of conversations in which an assistant may say just one thing."""
    turns = V.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.struct("turn", "role", "text").alias("order"), F.col("turn").alias("seq"), F.col("role").alias("state"))
    return logs.illegal_transitions(turns, "session_id", "order", "state", {("user", "assistant"), ("system", "user")}).select("session_id", F.col("order.turn").alias("seq"), "before", "state")


_RETRIES = """SELECT session_id, seq, CASE WHEN done AND key IS NOT NULL AND key = owner THEN 'replay' WHEN done THEN 'finished' WHEN mine THEN 'proceed' ELSE 'busy' END AS answer FROM (
SELECT *, coalesce(max(CASE WHEN mine AND finishes THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS done FROM (
SELECT *, owner IS NULL OR coalesce(key = owner, false) AS mine FROM (
SELECT *, first_value(key IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM session_calls)))"""


@register("win06_idempotent_retry", sql(_RETRIES, "session_calls"))
def win06(spark, d):
    return logs.retries(V.session_calls(spark, d)).select("session_id", "seq", "answer")


@register("win07_cheapest_tier", """SELECT request, CASE WHEN NOT refused THEN tier END AS tier, refused FROM (SELECT event_id // 4 AS request, event_type AS tier, event_id AS ord, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 5 ELSE 3 END AS cost,
value > 20 AS hit, event_type = 'purchase' AND value < 5 AS refused FROM events) WHERE hit OR refused QUALIFY row_number() OVER (PARTITION BY request ORDER BY cost, ord) = 1""")
def win07(spark, d):
    e = V.table(spark, d, "events")
    cost = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 5).otherwise(3)
    offers = e.select(F.expr("event_id div 4").alias("request"), F.col("event_type").alias("tier"), F.col("event_id").alias("ord"), cost.alias("cost"), (F.col("value") > 20).alias("hit"), ((F.col("event_type") == "purchase") & (F.col("value") < 5)).alias("refused"))
    return logs.cheapest(offers, "request")


@register("win08_memo_hit", sql("""SELECT at_, key, CASE WHEN hit THEN 'memo' ELSE tier END AS tier, CASE WHEN hit THEN 0 ELSE cost END AS cost FROM (SELECT *, coalesce(max(crystallises::INT) OVER (PARTITION BY key ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS hit FROM requests)""", "requests"))
def win08(spark, d):
    return logs.memoised(V.requests(spark, d)).select(F.col("at").alias("at_"), "key", "tier", "cost")
