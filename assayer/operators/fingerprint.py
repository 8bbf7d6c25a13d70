"""Content-derived ids of file sets, and what is there against what should be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.functions import globs

from .matrix import placed

#: So many entries of a set are hashed into one node of its tree.
NODE = 10_000


def tree_rolled_up(files: DataFrame, keys: list[str], kind: str, fields: list[str], node: int = NODE) -> DataFrame:
    """(keys, id, n): one id for each set of files of any size, whatever the order of their rows.

    Entries are numbered in the order of the fields. Each run of `node` of them is one hash,
    and the id is a hash over these in order; runs are cut by place, so the id does not
    depend on how rows are dealt out. A task sees a range of a set, and a set's row one
    hash for each run.
    """
    runs = placed(files.select(*keys, *fields), keys, fields).withColumn("_run", F.expr(f"(pos - 1) div {int(node)}"))
    listed = F.array_sort(F.collect_list(F.struct("pos", *fields)))
    entries = F.transform(listed, lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    nodes = runs.groupBy(*keys, "_run").agg(F.sha2(F.to_json(entries).cast("binary"), 256).alias("_hash"), F.count(F.lit(1)).alias("_n"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("_run", "_hash"))), lambda x: x["_hash"])
    return nodes.groupBy(*keys).agg(C.content_id(kind, F.to_json(hashes)).alias("id"), F.sum("_n").alias("n"))


def reconciled(manifest: DataFrame, found: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """(keys, outcome): full outer comparison of a manifest with what is found.

    fields maps a column to the outcome of its difference, in order of precedence, after
    `missing` and `extra`; equal rows are `ok`.
    """
    m = manifest.select(*keys, *[F.col(c).alias(f"m_{c}") for c in fields], F.lit(True).alias("m_here"))
    f = found.select(*keys, *[F.col(c).alias(f"f_{c}") for c in fields], F.lit(True).alias("f_here"))
    outcome = F.when(F.col("f_here").isNull(), "missing").when(F.col("m_here").isNull(), "extra")
    for c, name in fields.items():
        outcome = outcome.when(C.differs(F.col(f"m_{c}"), F.col(f"f_{c}")), name)
    return m.join(f, keys, "full").select(*keys, outcome.otherwise("ok").alias("outcome"))


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): created, deleted, modified and mode-changed files; (keys, hash, mode) on both sides."""
    names = {"missing": "deleted", "extra": "created"}
    seen = reconciled(before, after, keys, {"hash": "modified", "mode": "mode_changed"}).filter("outcome <> 'ok'")
    known = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    return seen.select(*keys, F.coalesce(F.try_element_at(known, F.col("outcome")), F.col("outcome")).alias("change"))


def uncovered(paths: DataFrame, policies: DataFrame, keys: list[str], path: str = "path", patterns: str = "writable") -> DataFrame:
    """Rows of paths that no pattern (array `patterns` of the policy of their keys) covers: the root, a `dir/` that holds the path, or a glob that matches it.

    Patterns are met by an equi-join: each has a folder that all its paths lie in, and a path
    lies in as many folders as it has slashes. Only those that meet are compared, without a
    regular expression where a pattern is a folder or a plain path, else in Arrow batches that
    compile each pattern once. Paths without a policy are not covered.
    """
    each = policies.select(*keys, F.explode(patterns).alias("_pattern")).distinct()
    # A `dir/` is taken by the letter, whatever stands in it; as a glob it has a folder of its own.
    as_folder = F.when(F.col("_pattern").isin(".", "./"), "").when(F.col("_pattern").endswith("/"), F.col("_pattern"))
    rules = each.select(*keys, "_pattern", as_folder.alias("_folder"), F.lit(True).alias("_all")).filter("_folder is not null").union(each.select(*keys, "_pattern", globs.fixed_folder(F.col("_pattern")), F.lit(False)))
    places = paths.select(*keys, F.col(path).alias("_path")).distinct().select(*keys, "_path", F.explode(globs.folders(F.col("_path"))).alias("_folder"))
    met = places.join(rules, [*keys, "_folder"])
    plain = ~F.col("_pattern").rlike(r"[*?\[]")
    sure = met.filter(F.col("_all") | (plain & (F.col("_path") == F.col("_pattern"))))
    open_ = met.filter(~F.col("_all") & ~plain).filter(globs.matches("_path", "_pattern"))
    covered = sure.select(*keys, "_path").union(open_.select(*keys, "_path")).distinct().withColumnRenamed("_path", path)
    return paths.join(covered, [*keys, path], "left_anti").select(*paths.columns)


def escapes(changed: DataFrame, policies: DataFrame, keys: list[str]) -> DataFrame:
    """Changed paths that no writable pattern (array `writable` of a policy) covers; what has no policy at all is left out."""
    return uncovered(changed.join(policies.select(*keys).distinct(), keys, "left_semi"), policies, keys)


def identity_verdicts(subjects: DataFrame, pins: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, state, n_moved, first_moved) of every subject: not_applicable without pins, error if
    a pinned path is gone, fail if one has another id, else pass.

    pins are (key, path, before_id), after (key, path, after_id). The moved paths themselves
    are rows of pinned(); a verdict has their number and the first of them.
    """
    moved = F.col("state") == "fail"
    found = pinned(pins, after, key).groupBy(key).agg(
        F.when(F.bool_or(F.col("state") == "error"), "error").when(F.bool_or(moved), "fail").otherwise("pass").alias("_state"), F.count_if(moved).alias("_n"), F.min(F.when(moved, F.col("path"))).alias("first_moved"))
    return subjects.select(key).distinct().join(found, key, "left").select(key, F.coalesce("_state", F.lit("not_applicable")).alias("state"), F.coalesce("_n", F.lit(0)).alias("n_moved"), "first_moved")


def pinned(pins: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, path, state) of every pin: error if its path is gone, fail if it has another id, else pass."""
    state = F.when(F.col("after_id").isNull(), "error").when(F.col("after_id") != F.col("before_id"), "fail").otherwise("pass")
    return pins.join(after, [key, "path"], "left").select(key, "path", state.alias("state"))


def appended(known: DataFrame, new: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to add, reused, in conflict): new rows by what stands under their id.

    An id holds what is known under it, else the least content of its new rows (null before
    all others). One row of it is added; others with that content are reused, and those with
    another one are conflicts.
    """
    own = F.struct(F.col(content).isNotNull().alias("there"), F.col(content).alias("value"))
    held = known.groupBy(key).agg(F.min(own).alias("_known"))
    # New rows that are equal in id and content count together, so a frequent one is one row.
    least = new.groupBy(key).agg(F.min(own).alias("_least")).join(held, key, "left")
    numbered = new.groupBy(*new.columns).agg(F.count(F.lit(1)).alias("_n")).join(least, key)
    same = own == F.coalesce("_known", "_least")
    firsts = numbered.filter(F.col("_known").isNull() & same).groupBy(key).agg(F.min(F.struct(*new.columns)).alias("_row"))
    added = firsts.select("_row.*").select(*new.columns)
    rest = numbered.join(firsts.select(F.col(key), F.struct(*[F.col("_row")[c].alias(c) for c in new.columns]).alias("_row")), key, "left")
    spare = F.col("_n") - F.coalesce(F.struct(*new.columns).eqNullSafe(F.col("_row")).cast("int"), F.lit(0))
    again = rest.filter(same).withColumn("_", F.explode(F.when(spare > 0, F.sequence(F.lit(1), spare.cast("int"))).otherwise(F.array().cast("array<int>")))).select(*new.columns)
    other = numbered.filter(~same).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*new.columns)
    return added, again, other
