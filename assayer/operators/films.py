"""Ordered sequences: differences, first divergence, and whether a run was reproduced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.folders import settled


#: Epochs that one digest stands for, and how many of these stand under one more.
RUN, RUNS = 64, 64


def compared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, t, same): films (key, t, film) epoch by epoch; an epoch that one side lacks has no film there."""
    both = left.select(key, "t", F.col("film").alias("_l")).join(right.select(key, "t", F.col("film").alias("_r")), [key, "t"], "full")
    return both.select(key, "t", F.col("_l").eqNullSafe(F.col("_r")).alias("same"))


def _digests(films: DataFrame, key: str) -> DataFrame:
    """(key, run, digest, last): a digest of each run of RUN epochs, made of sums, so that most of it is added up before the shuffle; films that are null add nothing."""
    mark = lambda seed: F.when(F.col("film").isNotNull(), F.xxhash64(F.lit(seed), "t", "film"))
    digest = F.struct(F.coalesce(F.bit_xor(mark(1)), F.lit(0)).alias("x"), F.coalesce(F.sum(mark(2).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"), F.count("film").alias("n"))
    return films.groupBy(key, F.expr(f"(t - 1) div {RUN}").cast("long").alias("run")).agg(digest.alias("digest"), F.max("t").alias("last"))


def divergence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, first_divergence, epochs, identical) of films (key, t, film), t from 1, once each.

    Strips are compared by digests of runs of runs, then by those of the runs in the first
    that differs, then by the epochs of the first run that differs: what is alike moves as a
    row for each RUN * RUNS epochs. Digests of 191 bits stand for their epochs.
    """
    sides = [settled(_digests(df, key)) for df in (left, right)]
    above = [d.groupBy(key, F.expr(f"run div {RUNS}").alias("wide")).agg(F.struct(F.bit_xor("digest.x").alias("x"), F.sum("digest.s").alias("s"), F.sum("digest.n").alias("n")).alias("digest"), F.max("last").alias("last")) for d in sides]

    def differing(a: DataFrame, b: DataFrame, at: str) -> DataFrame:
        """(key, at): the first place where two sides differ."""
        both = a.select(key, at, F.col("digest").alias("_a")).join(b.select(key, at, F.col("digest").alias("_b")), [key, at], "full")
        none = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("decimal(38,0)").alias("s"), F.lit(0).cast("long").alias("n"))
        plain = lambda c: F.when(F.col(c)["n"] > 0, F.struct(F.col(c)["x"].alias("x"), F.col(c)["s"].cast("decimal(38,0)").alias("s"), F.col(c)["n"].alias("n"))).otherwise(none)
        return both.filter(plain("_a") != plain("_b")).groupBy(key).agg(F.min(at).alias(at))

    wide = settled(differing(*above, "wide"))
    inside = [d.withColumn("wide", F.expr(f"run div {RUNS}")).join(wide, [key, "wide"], "left_semi") for d in sides]
    run = settled(differing(*inside, "run"))
    epochs = [df.withColumn("run", F.expr(f"(t - 1) div {RUN}").cast("long")).join(run, [key, "run"], "left_semi") for df in (left, right)]
    first = compared(*epochs, key).filter("not same").groupBy(key).agg(F.min("t").alias("first_divergence"))
    sizes = above[0].groupBy(key).agg(F.max("last").alias("_l")).join(above[1].groupBy(key).agg(F.max("last").alias("_r")), key, "full")
    alike = F.col("first_divergence").isNull() & F.col("_l").eqNullSafe(F.col("_r"))
    return sizes.join(first, key, "left").select(key, "first_divergence", F.greatest("_l", "_r").alias("epochs"), alike.alias("identical"))


def final(films: DataFrame, key: str) -> DataFrame:
    """(key, film) of the last epoch."""
    return films.groupBy(key).agg(F.max_by("film", "t").alias("film"))


def reproduced(films: DataFrame, pins: DataFrame, key: str) -> DataFrame:
    """(key, reproduced): whether the last film is the pinned one; null where nothing is pinned."""
    return final(films, key).join(pins, key, "left").select(key, (F.col("film") == F.col("pinned")).alias("reproduced"))


def agreement(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Counts of agreed, disagreed, unavailable and skipped outcomes; the total leaves skips out."""
    n = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return outcomes.groupBy(*keys).agg(n("agreed"), n("disagreed"), n("unavailable"), n("skipped"), F.count_if(F.col("outcome") != "skipped").alias("total"))
