"""Candidates by tasks: cells, pairs, refusals, differences and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.functions.folders import settled

_SIDE = ("candidate_key", "episode_key", "status", "reward")


def pairs(cells: DataFrame, task: str = "task_key", fields: tuple[str, ...] = _SIDE) -> DataFrame:
    """Each unordered pair of a task's candidates once, as structs left and right of the fields.

    Candidates of a task are few, so a task's cells are gathered in one array (a shuffle
    by task) and paired there; no self-join reads the cells twice. The first field tells
    a task's cells apart; fields may be maps, which have no order.
    """
    by_key = lambda a, b: F.when(a[fields[0]] < b[fields[0]], -1).when(a[fields[0]] > b[fields[0]], 1).otherwise(0)
    gathered = F.collect_list(F.struct(*fields))
    side = F.array_sort(gathered) if fields == _SIDE else F.array_sort(gathered, by_key)
    grouped = cells.groupBy(task).agg(side.alias("sides"))
    left = grouped.select(task, "sides", F.posexplode("sides").alias("i", "left"))
    return left.select(task, "left", F.explode(F.slice("sides", F.col("i") + 2, F.size("sides"))).alias("right"))


def compared(pair: DataFrame) -> DataFrame:
    """pairs with relation and right_minus_left."""
    l, r = F.col("left.reward"), F.col("right.reward")  # noqa: E741
    return pair.withColumn("relation", C.relation(l, r)).withColumn("right_minus_left", r - l)


def one_per_cell(cells: DataFrame) -> DataFrame:
    """(task_key, candidate_key, n): cells that hold more than one episode."""
    return cells.groupBy("task_key", "candidate_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def grid_refusals(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """(task_key, left_key, right_key, missing): pairs of which a side has no scored cell.

    The grid is made for each task from the candidate keys, which are one row: a batch names
    them in one document.
    """
    keys = F.broadcast(candidates.agg(F.array_sort(F.collect_set("candidate_key")).alias("keys")))
    have = cells.groupBy("task_key").agg(F.collect_set(F.when(F.col("reward").isNotNull(), F.col("candidate_key"))).alias("have")).join(keys)
    left = have.select("task_key", "have", "keys", F.posexplode("keys").alias("i", "left_key"))
    pair = left.select("task_key", "have", "left_key", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("right_key"))
    missing = F.array_except(F.array("left_key", "right_key"), "have")
    return pair.select("task_key", "left_key", "right_key", F.array_join(missing, ",").alias("missing")).filter("missing <> ''")


def same_task(pair: DataFrame, episodes: DataFrame) -> DataFrame:
    """Pairs (left_key, right_key) of episodes (episode_key, task_key) that answer different tasks."""
    l = episodes.select(F.col("episode_key").alias("left_key"), F.col("task_key").alias("left_task"))  # noqa: E741
    r = episodes.select(F.col("episode_key").alias("right_key"), F.col("task_key").alias("right_task"))
    both = pair.join(l, "left_key").join(r, "right_key")
    return both.filter(C.differs(F.col("left_task"), F.col("right_task"))).select("left_key", "right_key", "left_task", "right_task", F.lit("TASK_MISMATCH").alias("code"))


def map_differences(left: Column, right: Column) -> Column:
    """Array of (key, left, right) where two maps differ; an absent key is a null, and so is every key of a null map."""
    at = lambda m, k: F.try_element_at(m, k)
    names = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    keys = F.array_sort(F.array_distinct(F.concat(names(left), names(right))))
    return F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), at(left, k).alias("left"), at(right, k).alias("right"))), lambda d: ~d["left"].eqNullSafe(d["right"]))


def field_differences(left: Column, right: Column, fields: tuple[str, ...]) -> Column:
    """Array of (field, key, left, right) where maps of the same name in two records differ."""

    def of(field: str) -> Column:
        return F.transform(map_differences(left[field], right[field]), lambda d: F.struct(F.lit(field).alias("field"), d["key"].alias("key"), d["left"].alias("left"), d["right"].alias("right")))

    return F.flatten(F.array(*map(of, fields)))


def candidate_rows(cells: DataFrame) -> DataFrame:
    """(candidate_key, pos, task_key, episode_key): each candidate's episodes in task order, a row each."""
    return placed(cells.select("candidate_key", "task_key", "episode_key"), ["candidate_key"], ["task_key", "episode_key"]).select("candidate_key", "pos", "task_key", "episode_key")


def batch_totals(cells: DataFrame) -> DataFrame:
    """One row of counts: candidates, tasks, episodes, scored, comparisons and refusals.

    Cells are read once: a task with n cells, s of them scored, has s(s-1)/2 comparisons
    and refuses its other pairs.
    """
    sets = cells.groupingSets([("task_key",), ("candidate_key",)], "task_key", "candidate_key").agg(
        (F.grouping("task_key") == 0).alias("_task"), F.count(F.lit(1)).alias("_n"), F.count("reward").alias("_s"))
    over = lambda value: F.coalesce(F.sum(F.when(F.col("_task"), value)), F.lit(0)).cast("long")
    pair = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    return sets.agg(F.count_if(~F.col("_task")).alias("candidates"), F.count_if("_task").alias("tasks"), over(F.col("_n")).alias("episodes"), over(F.col("_s")).alias("scored"), over(pair("_s")).alias("comparisons"), over(pair("_n") - pair("_s")).alias("refusals"))


def wide(cells: DataFrame, candidates: list[str]) -> DataFrame:
    """A row for each task with each candidate's reward; candidates are a small list known beforehand."""
    return cells.groupBy("task_key").pivot("candidate_key", candidates).agg(F.min("reward"))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def placed(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """rows with `pos`, their place from 1 in their group's order; rows that are equal in it come in any order.

    Rows are dealt out by ranges of group and order, so a group may lie in many tasks and a
    task sees one range. A row's place in its range and the sizes of its group's ranges
    before give its place. The ranges are written down first, so that both counts see the
    same ones.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(rows.repartitionByRange(n, *groups, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most a row for each range and each group that lies in it.
    offsets = ranged.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    place = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order))
    return ranged.withColumn("pos", place).join(offsets, same).select(*rows.columns, (F.col("pos") + F.col("_before")).cast("long").alias("pos"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `pos`, their place from 1 in the order of a key."""
    return placed(rows.withColumn("_all", F.lit(0)), ["_all"], [key]).drop("_all")
