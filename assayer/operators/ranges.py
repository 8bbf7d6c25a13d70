"""Order rules of groups (sessions, worlds) that may be larger than a task.

Rows are dealt out by ranges of (group, order), so a group that holds a third of all rows lies
in many tasks, and each task holds at most two groups that it shares with others: the first
and the last one. What a task does to those is small (a map from state to state, one row),
so it is gathered, at most two rows a task, put together in the order of the tasks, and
handed back to the tasks that go on where others ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assayer.functions.folders import settled


def dealt(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows in the order of group and order, over all tasks, written down so that tasks see the same rows again."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order))


def starts(groups: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Whether each row begins a group; the first one does unless its group is that of `last`."""
    codes = pc.fill_null(groups.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    begins = np.diff(codes, prepend=codes[0] - 1) != 0
    begins[0] = last is None or not groups[0].equals(last)
    return begins


class Automaton:
    """States that actions lead on to; an action that is not known changes nothing. The first state is where groups begin."""

    def __init__(self, states: list[str], actions: list[str], step: Callable[[str, str], str]):
        self.states, self.actions = states, actions
        self.table = np.array([*([states.index(step(s, a)) for s in states] for a in actions), range(len(states))], np.int8)

    def maps(self, actions: pa.Array) -> np.ndarray:
        """A map from states to states for each row."""
        at = pc.fill_null(pc.index_in(actions, value_set=pa.array(self.actions)), len(self.actions))
        return self.table[at.to_numpy(zero_copy_only=False)]

    def passed(self, maps: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For each row the map of its group's rows in this batch up to it, by doubling."""
        maps = maps.copy()
        place = np.arange(len(maps))
        inside = place - np.maximum.accumulate(np.where(begins, place, 0))
        reach = 1
        while reach <= inside.max(initial=0):
            at = np.flatnonzero(inside >= reach)
            maps[at] = np.take_along_axis(maps[at], maps[at - reach], 1)
            reach *= 2
        return maps


def _ends(automaton: Automaton, group: str, action: str):
    """Of each task: its first group with the map that its rows there make, and its last group with the state that they leave it in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = None, None
        through, state, alone = np.arange(len(automaton.states), dtype=np.int8), 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(group)
            begins = starts(groups, last)
            if first is None:
                first, begins[0] = groups[0], False
            maps = automaton.passed(automaton.maps(batch.column(action)), np.append(True, begins[1:]))
            cuts = np.flatnonzero(begins)
            if alone:
                end = int(cuts[0]) if len(cuts) else len(maps)
                if end:
                    through = maps[end - 1][through]
                alone = not len(cuts)
            if not alone:
                state = int(maps[-1][0 if len(cuts) else state])
            last = groups[len(groups) - 1]
        if first is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first.as_py()], first.type), pa.array([last.as_py()], last.type), pa.array([through.tolist()], pa.list_(pa.int32())), pa.array([None if alone else state], pa.int32())],
                ["part", "first", "last", "through", "state"],
            )

    return run


def with_states(rows: DataFrame, group: str, order: list[str], action: str, automaton: Automaton, name: str = "state") -> DataFrame:
    """rows with the state that each action finds; `order` tells the rows of a group apart."""
    sorted_rows = dealt(rows, group, order)
    kind = rows.schema[group].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", kind), T.StructField("last", kind), T.StructField("through", T.ArrayType(T.IntegerType())), T.StructField("state", T.IntegerType())])
    entry: dict[int, int] = {}
    before, state = object(), 0
    for r in sorted(sorted_rows.select(group, action).mapInArrow(_ends(automaton, group, action), schema).collect(), key=lambda r: r.part):
        entry[r.part] = state if r.first == before else 0
        state = r.through[entry[r.part]] if r.state is None else r.state
        before = r.last

    names = pa.array(automaton.states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, entry.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = starts(batch.column(group), last)
            begins[0] &= last is not None
            maps = automaton.passed(automaton.maps(batch.column(action)), np.append(True, begins[1:]))
            place = np.arange(len(maps))
            opened = np.maximum.accumulate(np.where(begins, place, 0))
            own = np.where((opened == 0) & ~begins[0], now, 0)
            found = np.where(place == opened, own, maps[place - 1, own])
            now = int(maps[-1, own[-1]])
            last = batch.column(group)[batch.num_rows - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(pa.array(found))], [*batch.schema.names, name])

    return sorted_rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def with_previous(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the value that the row before has in its group, null for the first one."""
    sorted_rows = dealt(rows, group, order)
    kinds = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("last", rows.schema[group].dataType), T.StructField("value", rows.schema[value].dataType)])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            tail = batch.slice(batch.num_rows - 1) if batch.num_rows else tail
        if tail is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), tail.column(group), tail.column(value)], ["part", "last", "value"])

    tails = {r.part: (r.last, r.value) for r in sorted_rows.select(group, value).mapInArrow(ends, kinds).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier = [p for p in tails if p < TaskContext.get().partitionId()]
        held = tails[max(earlier)] if earlier else None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, values = batch.column(group), batch.column(value)
            last = None if held is None else pa.array([held[0]], groups.type)
            begins = starts(groups, None if last is None else last[0])
            moved = pa.concat_arrays([pa.array([None if held is None else held[1]], values.type), values.slice(0, len(values) - 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(pa.array(begins), pa.scalar(None, values.type), moved)], [*batch.schema.names, name])
            held = (groups[len(groups) - 1].as_py(), values[len(values) - 1].as_py())

    return sorted_rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, rows.schema[value].dataType)]))
