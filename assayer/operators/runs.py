"""Recorded command runs against what was expected of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected(runs: DataFrame) -> DataFrame:
    """runs with `met`: whether the exit code is allowed; [0] where nothing is said."""
    allowed = F.coalesce(F.col("expected_exit_codes"), F.array(F.lit(0)))
    return runs.withColumn("met", F.coalesce(F.array_contains(allowed, F.col("exit_code")), F.lit(False)))


def tests_verdict(episodes: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, state) from runs (key, phase, error, met) and episodes (key, has_plan, has_patch).

    No plan: not_applicable. A run that broke, or a baseline that is not as expected:
    error. No patched tree, or a patched run not as expected: fail. Else pass.
    """
    phase = lambda name: F.coalesce(F.bool_and(F.when(F.col("phase") == name, F.col("met"))), F.lit(True))
    per = runs.groupBy(key).agg(F.bool_or(F.col("error").isNotNull()).alias("broke"), phase("baseline").alias("baseline"), phase("patched").alias("patched"))
    state = (
        F.when(~F.col("has_plan"), "not_applicable").when(F.coalesce("broke", F.lit(True)) | ~F.col("baseline"), "error")
        .when(~F.col("has_patch") | ~F.col("patched"), "fail").otherwise("pass")
    )
    return episodes.join(per, key, "left").select(key, state.alias("state"))


def policy_violations(policies: DataFrame, profiles: DataFrame) -> DataFrame:
    """Policies (policy, runner_profile, network) that ask for what their profile does not deliver.

    Profiles are a row each; Spark broadcasts them while they are small.
    """
    known = profiles.select("runner_profile", F.col("network").alias("_provides"), F.col("executes").alias("_executes"))
    wrong = F.when(F.col("_executes").isNull(), "unknown_profile").when(F.col("_executes") & (F.col("network") != F.col("_provides")), "network_not_provided")
    return policies.join(known, "runner_profile", "left").withColumn("code", wrong).filter("code is not null").drop("_provides", "_executes")
