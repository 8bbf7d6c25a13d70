"""Checks that records refer to what exists and say what can be derived again.

A failed check is a row, never an exception: (owner, ..., code).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import columns as C


def dangling(refs: DataFrame, targets: DataFrame, key: str, code: str) -> DataFrame:
    """refs whose key no target has."""
    return refs.join(targets.select(key).distinct(), key, "left_anti").withColumn("code", F.lit(code))


def unbound(refs: DataFrame, verified: DataFrame, key: str, fields: list[str], code: str) -> DataFrame:
    """refs that are bound to other values of `fields` than the verified record with their key."""
    v = verified.select(key, *[F.col(f).alias(f"_v_{f}") for f in fields])
    wrong = F.lit(False)
    for f in fields:
        wrong = wrong | C.differs(F.col(f), F.col(f"_v_{f}"))
    return refs.join(v, key).filter(wrong).select(*refs.columns, F.lit(code).alias("code"))


def with_subject(tasks: DataFrame, subjects: DataFrame, split: str) -> DataFrame:
    """tasks with the one subject (split, snapshot_id) that all tasks of their split share, and a code where there is none.

    Subjects are a row a split; Spark broadcasts them while they are small.
    """
    joined = tasks.join(subjects.select(split, "snapshot_id"), split, "left")
    return joined.select(*tasks.columns, "snapshot_id", F.when(F.col("snapshot_id").isNull(), "SUBJECT_MISSING").alias("code"))


def replayed(recorded: DataFrame, derived: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, agrees): recorded values against derived ones, key sets included."""
    r = recorded.select(*keys, F.col(value).alias("_r"), F.lit(True).alias("_in_r"))
    d = derived.select(*keys, F.col(value).alias("_d"), F.lit(True).alias("_in_d"))
    return r.join(d, keys, "full").select(*keys, (F.col("_in_r").eqNullSafe(F.col("_in_d")) & F.col("_r").eqNullSafe(F.col("_d"))).alias("agrees"))


def outcome(checks: DataFrame, key: str) -> DataFrame:
    """(key, outcome, failed) of checks (key, check, ok): a failed `versions` check makes it unavailable."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("check"))))
    per = checks.groupBy(key).agg(failed.alias("_failed"))
    state = F.when(F.array_contains("_failed", "versions"), "unavailable").when(F.size("_failed") > 0, "mismatch").otherwise("closed")
    return per.select(key, state.alias("outcome"), F.array_join("_failed", ", ").alias("failed"))


def noncanonical(members: DataFrame, owner: str, pos: str, member: str) -> DataFrame:
    """Members that do not come strictly after the one before them."""
    before = F.lag(member).over(Window.partitionBy(owner).orderBy(pos))
    return members.withColumn("_before", before).filter(F.col("_before") >= F.col(member)).drop("_before")


def key_set(documents: DataFrame, key: str, body: str, expected: list[str], owned: list[str]) -> DataFrame:
    """(key, missing, unknown, server_owned) of JSON objects whose keys are not exactly the expected ones."""
    want, own = F.array(*map(F.lit, expected)), F.array(*map(F.lit, owned))
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    extra = F.array_except(keys, want)
    sets = documents.select(key, F.array_sort(F.array_except(want, keys)).alias("missing"), F.array_sort(F.array_except(extra, own)).alias("unknown"), F.array_sort(F.array_intersect(extra, own)).alias("server_owned"))
    return sets.select(key, *[F.array_join(c, ",").alias(c) for c in ("missing", "unknown", "server_owned")]).filter("missing <> '' or unknown <> '' or server_owned <> ''")


def member_audit(members: DataFrame, owner: str, path: str, required: list[str], prefixes: list[str], suffixes: list[str]) -> DataFrame:
    """(owner, path, code): required members that are absent, forbidden ones that are there, and paths that escape."""
    p = F.col(path)
    bad = F.lit(False)
    for x in prefixes:
        bad = bad | p.startswith(x)
    for x in suffixes:
        bad = bad | p.endswith(x)
    code = F.when(C.safe_path(p).isNull(), "escapes").when(bad, "forbidden")
    present = members.filter(code.isNotNull()).select(owner, path, code.alias("code"))
    has = members.groupBy(owner).agg(F.collect_set(F.when(p.isin(*required), p)).alias("_has"))
    return present.union(has.select(owner, F.explode(F.array_except(F.array(*map(F.lit, required)), "_has")).alias(path), F.lit("absent").alias("code")))
