"""Scores of episodes against a rubric of weighted signals and conditional caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(episodes: DataFrame, rubrics: DataFrame, rubric_id: str, verification: str = "verification", tampered: str = "tampered") -> DataFrame:
    """episodes with reward, status and validity.

    episodes has a map from signal to one of pass, fail, not_applicable and error; rubrics
    has, for each rubric, the arrays `signals` (signal, weight), `required` and `caps`
    (signal, state, reward_max). In this order: tampered gives (0, invalid, invalid); any
    error (null, error, invalid); a required signal that does not apply (null, invalid,
    invalid); else the weights of passed signals, at most the least triggered cap, with
    (ok, valid). Weights are whole numbers, so no order of adding can move a reward.

    Rubrics are a small dimension; each is one row, so the join needs no shuffle of
    episodes while Spark can broadcast it, and everything else is a projection.
    """
    states = F.col(verification)
    is_in = lambda signal, state: F.coalesce(F.try_element_at(states, signal) == state, F.lit(False))
    raw = F.aggregate("signals", F.lit(0).cast("long"), lambda total, s: total + F.when(is_in(s["signal"], "pass"), s["weight"]).otherwise(F.lit(0).cast("long")))
    cap = F.array_min(F.transform(F.filter("caps", lambda c: is_in(c["signal"], c["state"])), lambda c: c["reward_max"]))
    error = F.exists(F.map_values(states), lambda s: s == "error")
    skipped = F.exists("required", lambda s: is_in(s, "not_applicable"))
    joined = episodes.join(rubrics, rubric_id)
    nothing = F.lit(None).cast("long")
    verdict = (
        F.when(F.col(tampered), _verdict(F.lit(0).cast("long"), "invalid", "invalid"))
        .when(error, _verdict(nothing, "error", "invalid"))
        .when(skipped, _verdict(nothing, "invalid", "invalid"))
        .otherwise(_verdict(F.least(raw, cap), "ok", "valid"))
    )
    return joined.withColumn("_verdict", verdict).select(*episodes.columns, "_verdict.*")


def _verdict(reward: Column, status: str, validity: str) -> Column:
    return F.struct(reward.alias("reward"), F.lit(status).alias("status"), F.lit(validity).alias("validity"))


def score_violations(states: DataFrame, scored: DataFrame, key: str, known: tuple[str, ...] = ("pass", "fail", "not_applicable", "error")) -> DataFrame:
    """(key, signal, code): states outside the four, and signals of `scored` that an episode lacks.

    states is (key, signal, state); scored has the signals that a rubric scores or requires.
    They come from one document and are broadcast as one row of their names.
    """
    unknown = states.filter(~F.col("state").isin(*known)).select(key, "signal", F.lit("unknown_state").alias("code"))
    per = states.groupBy(key).agg(F.collect_set("signal").alias("has"))
    wanted = scored.agg(F.array_sort(F.collect_set("signal")).alias("want"))
    missing = per.join(F.broadcast(wanted)).select(key, F.explode(F.array_except("want", "has")).alias("signal"), F.lit("missing_signal").alias("code"))
    return unknown.union(missing)


def totals(receipts: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, and sum and mean of the scored rewards (null where none is scored)."""
    count = lambda status: F.count_if(F.col("status") == status).alias(f"n_{status}")
    scored = F.count("reward").alias("scored")
    return receipts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), count("ok"), count("invalid"), count("error"), scored,
        F.coalesce(F.sum("reward"), F.lit(0)).alias("reward_sum"), F.avg("reward").alias("reward_mean"),
    )


def persistence(requested: Column, evaluated: Column, artifacts: Column, written: Column) -> Column:
    """Struct (persistence, reason) of an episode: what became of the evidence that the caller asked to keep.

    It says nothing about the score: without an episode there is nothing to keep
    (unavailable), an episode without artifacts or one whose artifacts could not be written
    is an error of persistence, whatever its status.
    """
    outcome = lambda state, reason: F.struct(F.lit(state).alias("persistence"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(~requested, outcome("not_requested", None)).when(~evaluated, outcome("unavailable", "no_episode")).when(~artifacts, outcome("error", "no_artifacts"))
        .when(~written, outcome("error", "write_failed")).otherwise(outcome("closed", None))
    )


def run_grade(episodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, grade) of (keys, status, persistence): 2 if evidence was not kept, else 1 unless all are ok, else 0."""
    grade = F.when(F.bool_or(F.col("persistence") == "error"), 2).when(F.bool_or(F.col("status") != "ok"), 1).otherwise(0)
    return episodes.groupBy(*keys).agg(grade.alias("grade"))
