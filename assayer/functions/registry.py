"""The seam for verifiers: column rules or functions from tables to verdicts, with versions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A verifier that needs more than its episode's row: DataFrame -> DataFrame (episode_key, state).
Verifier = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Rule:
    """A verifier whose state is a column of the context."""

    state: Callable[[], Column]


@dataclass(frozen=True)
class Fold:
    """A verifier whose state is an aggregate over an episode's rows of a table, which it shares with other folds."""

    state: Callable[[], Column]


class Registry:
    """Verifiers by signal, and a version each."""

    def __init__(self, known: Mapping[str, tuple[str, Verifier | Rule | Fold]]):
        self.known = dict(known)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(signal, version)"""
        return spark.createDataFrame([(s, v) for s, (v, _) in sorted(self.known.items())], "signal string, version string")

    def run(self, context: DataFrame, signals: list[str], extra: Mapping[str, tuple[str, Verifier | Rule | Fold]] | None = None, registry_given: bool = False, table: DataFrame | None = None) -> DataFrame:
        """(episode_key, signal, state, version, source); signals without an implementation are `error`.

        All rules are one projection over the context, and all folds one aggregate over
        `table` (episode_key and whatever they ask for), so each is read once and moved once
        at most, added up before it moves; each other verifier is a branch of its own. An
        episode without rows in the table has no fold's verdict. Injected verifiers and a
        registry of the caller's own exclude each other.
        """
        if extra and registry_given:
            raise ValueError("give a registry or extra verifiers, not both")
        verdicts, folds, branches = [], [], []
        for signal in signals:
            version, verifier, source = (*extra[signal], "injected") if extra and signal in extra else (*self.known[signal], "registry") if signal in self.known else (None, Rule(lambda: F.lit("error")), "none")
            named = F.lit(signal).alias("signal"), F.lit(version).cast("string").alias("version"), F.lit(source).alias("source")
            if isinstance(verifier, Rule):
                verdicts.append(F.struct(named[0], verifier.state().alias("state"), *named[1:]))
            elif isinstance(verifier, Fold):
                folds.append(F.struct(named[0], verifier.state().alias("state"), *named[1:]))
            else:
                branches.append(verifier(context).select("episode_key", named[0], "state", *named[1:]))
        if verdicts:
            branches.insert(0, context.select("episode_key", F.explode(F.array(*verdicts)).alias("v")).select("episode_key", "v.*"))
        if folds:
            if table is None:
                raise ValueError("folds need a table")
            branches.append(table.groupBy("episode_key").agg(F.array(*folds).alias("_v")).select("episode_key", F.explode("_v").alias("v")).select("episode_key", "v.*"))
        found = branches[0]
        for more in branches[1:]:
            found = found.unionByName(more)
        return found


def each(rows: DataFrame, key: str, item: str, run: Callable[[list], list[str | None]]) -> DataFrame:
    """(key, output, error): a function for each item, for work that Spark has no expression for.

    `run` takes the items of a batch and gives a text or None for each. If it fails for a
    batch, its items are tried one by one and those that fail have the error's name.
    """
    import pyarrow as pa

    def one(value) -> tuple[str | None, str | None]:
        try:
            return run([value])[0], None
        except Exception as e:  # an item's failure is a row, not the job's end
            return None, type(e).__name__

    def batches(parts):
        for part in parts:
            items = part.column(1).to_pylist()
            try:
                outcome = [(x, None) for x in run(items)]
            except Exception:
                outcome = [one(x) for x in items]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o for o, _ in outcome], pa.string()), pa.array([e for _, e in outcome], pa.string())], [key, "output", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, item).mapInArrow(batches, f"`{key}` {kind}, output string, error string")
