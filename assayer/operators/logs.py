"""Decision and route logs, and the order rules of sessions and requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.folders import settled

from . import ranges

#: The state that an accepted action leads to from each state of a session.
ACCEPTED = {
    ("none", "start"): "started", ("started", "finalize"): "finalizing", ("finalizing", "finalized"): "finalized", ("finalizing", "finalize_failed"): "finalize_failed",
    ("started", "close"): "closed", ("finalized", "close"): "closed", ("finalize_failed", "close"): "closed",
}


def session_step(state: str, action: str) -> tuple[str, str]:
    """(answer, next state) of one action; session_answers says the same of whole tables."""
    if (state, action) in ACCEPTED:
        return "accepted", ACCEPTED[state, action]
    if state in ("none", "closed") and action != "start":
        return "nothing" if action == "close" else "SESSION_UNKNOWN", state
    return "SESSION_BUSY" if action == "close" else "SESSION_STATE", state


def script_string(value: Column, kind: T.DataType) -> Column:
    """A value as a script writes it: whole doubles without a point, a missing value as `undefined`."""
    text = value.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # Digits are the shortest that tell the value; only their layout differs.
        size = F.abs(value)
        plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        power = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "E+$1"), "E", "e")
        whole = F.regexp_replace(value.try_cast("decimal(38,0)").cast("string"), "^-0$", "0")
        text = F.when(F.isnan(value) | (size == float("inf")), text).when(value == F.rint(value), F.when(size < 1e21, whole).otherwise(power)).when(size >= 1e-6, plain).otherwise(power)
    elif isinstance(kind, T.DecimalType):
        text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(text, F.lit("undefined"))


def truthy(value: Column, kind: T.DataType) -> Column:
    """Numbers but zero and NaN, strings but the empty one, true, and whatever else is there."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        test = (value != 0) & ~F.isnan(value)
    elif isinstance(kind, T.NumericType):
        test = value != 0
    elif isinstance(kind, T.StringType):
        test = value != ""
    else:
        test = value if isinstance(kind, T.BooleanType) else value.isNotNull()
    return F.coalesce(test, F.lit(False))


def where(rows: DataFrame, *tests: str) -> DataFrame:
    """Rows that pass all tests: `field` (is truthy), `field=value` or `field!=value` (as strings); a field that is not there is undefined."""
    for test in tests:
        field, unequal, value = re.fullmatch(r"(?s)([\w.]+)(!?)=(.*)", test).groups() if re.match(r"[\w.]+!?=", test) else (test, "", None)
        kind = rows.schema[field].dataType if field in rows.columns else T.StringType()
        column = rows[f"`{field}`"] if field in rows.columns else F.lit(None).cast("string")
        if value is None:
            rows = rows.filter(truthy(column, kind))
        else:
            equal = script_string(column, kind) == value
            rows = rows.filter(~equal if unequal else equal)
    return rows


def gate_counts(decisions: DataFrame, *keys: str) -> DataFrame:
    return decisions.groupBy(*keys).agg(F.count_if("allowed").alias("allow"), F.count_if(~F.col("allowed")).alias("refuse"), F.count(F.lit(1)).alias("total"))


def routes_by_tier(routes: DataFrame) -> DataFrame:
    tier = F.coalesce("tier", F.when(F.col("refused"), "refused").when(F.col("escalated"), "escalate"), F.lit("none"))
    return routes.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("cost", F.lit(0))).alias("cost"))


def result_tally(lines: DataFrame, name: str, line: str, codes: DataFrame | None = None) -> DataFrame:
    """(name, pass, fail, skip) of each log; with exit codes (name, code) also `crashed`.

    A run that ends with a code other than 0 and has no FAIL line broke before its tests or
    between them. A log without result lines, or without lines at all but with a code, counts.
    """
    mark = F.regexp_extract(line, r"^(PASS|FAIL|SKIP)\b", 1)
    n = lambda m: F.count_if(mark == m).alias(m.lower())
    tally = lines.groupBy(name).agg(n("PASS"), n("FAIL"), n("SKIP"))
    if codes is None:
        return tally
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pass", "fail", "skip")]
    joined = tally.join(codes.select(name, "code"), name, "full").select(name, *counts, F.coalesce("code", F.lit(0)).alias("code"))
    return joined.select(name, "pass", "fail", "skip", ((F.col("code") != 0) & (F.col("fail") == 0)).alias("crashed"))


def illegal_transitions(states: DataFrame, session: str, seq: str, state: str, legal: set[tuple[str, str]]) -> DataFrame:
    """(session, seq, before, state) of steps that no rule allows; rows of a long session lie in many tasks."""
    ok = F.lit(False)
    for a, b in sorted(legal):
        ok = ok | ((F.col("before") == a) & (F.col(state) == b))
    rows = ranges.with_previous(states.select(session, seq, state), session, [seq], state, "before")
    return rows.filter(F.col("before").isNotNull() & ~ok).select(session, seq, "before", state)


STATES = ["none", "started", "finalizing", "finalized", "finalize_failed", "closed"]
ACTIONS = ["start", "finalize", "finalized", "finalize_failed", "close"]
LIFECYCLE = ranges.Automaton(STATES, ACTIONS, lambda state, action: session_step(state, action)[1])


def session_answers(actions: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """actions (session, seq, action) with the `state` that they find and their `answer`.

    Actions are start, finalize, finalized, finalize_failed (how the claimed work ended) and
    close. A session is started once; one call claims its finalization; it cannot be closed
    while that runs, and closing forgets it. Refused actions change nothing: SESSION_UNKNOWN
    (not started, or closed; a close of such is `nothing`), SESSION_STATE, SESSION_BUSY; so
    does an unknown action, which has no answer.

    A session's actions are maps from state to state; those of a long session are put
    together range by range, so it needs no task of its own.
    """
    found = ranges.with_states(actions, session, [seq], "action", LIFECYCLE)
    said = F.create_map(*[F.lit(x) for s in STATES for a in ACTIONS for x in (f"{s}:{a}", session_step(s, a)[0])])
    return found.withColumn("answer", F.try_element_at(said, F.concat_ws(":", "state", "action"))).select(*actions.columns, "state", "answer")


def retries(calls: DataFrame, session: str = "session_id") -> DataFrame:
    """calls (session, seq, key, finishes) with `answer`; seq tells the calls of a session apart.

    The first key of a session owns it. Before the session is finished, the owner's call
    proceeds and other keys are busy; afterwards the owner's key replays the answer and
    any other, or none, is refused as finished. Only the owner can finish a session; before
    there is one, any call can.

    The owner and the first call that finishes are minima, added up before their shuffle.
    Calls meet them by session; sessions of more than WIDE calls (so no more than one in WIDE
    calls) get them by a broadcast, as such a session's calls must not meet in one task.
    """
    owners = settled(calls.groupBy(F.col(session).alias("_session")).agg(F.min(F.when(F.col("key").isNotNull(), F.struct("seq", "key"))).alias("_first"), F.count(F.lit(1)).alias("_n")))
    if owners.filter(F.col("_n") > WIDE).isEmpty():
        return _retried(calls, session, owners, lambda df: df)
    wide = owners.filter(F.col("_n") > WIDE)
    is_wide = F.col(session).eqNullSafe(F.col("_session"))
    narrow_calls = calls.join(F.broadcast(wide.select("_session")), is_wide, "left_anti")
    wide_calls = calls.join(F.broadcast(wide.select("_session")), is_wide, "left_semi")
    return _retried(wide_calls, session, wide, F.broadcast).union(_retried(narrow_calls, session, owners, lambda df: df))


#: A session of more calls is not brought together.
WIDE = 1_000_000


def _retried(calls: DataFrame, session: str, owners: DataFrame, how) -> DataFrame:
    owned = calls.join(how(owners.drop("_n")), F.col(session).eqNullSafe(F.col("_session"))).drop("_session")
    open_ = F.col("_first").isNull() | (F.col("seq") < F.col("_first.seq"))
    keyed = F.coalesce(F.col("key") == F.col("_first.key"), F.lit(False)) & ~open_
    mine = open_ | keyed
    ends = owned.filter(mine & F.col("finishes")).groupBy(F.col(session).alias("_session")).agg(F.min("seq").alias("_end"))
    told = owned.join(how(ends), F.col(session).eqNullSafe(F.col("_session")), "left")
    finished = F.coalesce(F.col("seq") > F.col("_end"), F.lit(False))
    answer = F.when(finished & keyed, "replay").when(finished, "finished").when(mine, "proceed").otherwise("busy")
    return told.withColumn("answer", answer).select(*calls.columns, "answer")


def cheapest(offers: DataFrame, request: str) -> DataFrame:
    """(request, tier, refused): offers (request, tier, cost, ord, hit, refused) tried by cost, then order.

    The first hit answers; a refused effectful tier before it ends the request.
    """
    stop = F.col("hit") | F.col("refused")
    tried = F.row_number().over(Window.partitionBy(request).orderBy("cost", "ord"))
    return offers.filter(stop).withColumn("_n", tried).filter("_n = 1").select(request, F.when(~F.col("refused"), F.col("tier")).alias("tier"), "refused")


def memoised(requests: DataFrame, key: str = "key") -> DataFrame:
    """requests with `cost` 0 and tier `memo` where an earlier one of the same key crystallised."""
    # The first one of each key is a minimum, added up before its shuffle; a join, unlike a window, splits a frequent key.
    first = requests.filter("crystallises").groupBy(F.col(key).alias("_key")).agg(F.min("at").alias("_first"))
    hit = F.coalesce(F.col("at") > F.col("_first"), F.lit(False))
    joined = requests.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_hit", hit)
    return joined.withColumn("tier", F.when(F.col("_hit"), "memo").otherwise(F.col("tier"))).withColumn("cost", F.when(F.col("_hit"), 0).otherwise(F.col("cost"))).select(*requests.columns)
