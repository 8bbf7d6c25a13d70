"""Submission sessions as streams.

Order: calls carry the producer's sequence number and an event time. They may arrive in any
order; a call waits until the watermark (the latest event time seen, less the delay that the
caller allows) has passed it, and calls of a session are answered in the producer's order.
A call whose turn has passed gets the answer LATE. So answers do not depend on how the stream
is cut into batches. State of a session that has been idle for IDLE of event time goes.

A batch that fails is tried again with its number. Sinks therefore write each batch to a
folder of its own, named by the stream's run and the batch's number, and overwrite it: a
second try leaves what one try leaves. `stored` reads all batches of all runs. What a stream
knows of earlier batches is in its state, on RocksDB, and never read back from its output.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.functions.folders import shared_folder
from assayer.operators import closure, logs, scoring

IDLE_MS = 24 * 3600 * 1000
#: Spark itself drops calls that are later than this; all others that come too late are answered as such.
HORIZON_MS = 30 * 24 * 3600 * 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def written(batch: DataFrame, path: str, run: str, number: int) -> None:
    """A batch in its own folder, whole, however often it is tried."""
    batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number:09d}")


def stored(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of all batches, with `run` and `batch` to tell them apart; none where the folder is not there yet, if the schema is given."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if schema is None or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.IntegerType())]))


def new_run() -> str:
    """The name of a stream's run; a run that goes on after a failure keeps its name, as it keeps its checkpoint."""
    return f"r{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Run a stream over all there is now; each batch goes to the sink once it is whole. With a checkpoint of an earlier run it goes on where that ended."""
    spark = stream.sparkSession
    where = checkpoint or f"{shared_folder(spark)}/checkpoint"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    query.awaitTermination()


def admission(key: str, body: str, expected: list[str], owned: list[str], accepted: str, refused: str, run: str) -> Callable[[DataFrame, int], None]:
    """A sink: submissions whose keys are exact go to one table, the others with what is wrong to another."""

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            wrong = closure.key_set(batch, key, body, expected, owned)
            written(wrong, refused, run, number)
            written(batch.join(wrong.select(key), key, "left_anti"), accepted, run, number)
        finally:
            batch.unpersist()

    return sink


def admitted(stream: DataFrame, key: str, body: str, expected: list[str], owned: list[str], accepted: str, refused: str) -> None:
    drained(stream, admission(key, body, expected, owned, accepted, refused, new_run()))


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


#: The sessions of a group as JSON rows (name, what its fold has come to, the sequence number answered last, the latest
#: time), and the calls that wait as a compressed Arrow stream whose first column is a session's place among these rows.
HELD = "sessions string, waiting binary"
#: Groups that sessions are dealt out to by their hash. A group is one row of state and one call of the fold, so these
#: cost the same for however many sessions; a batch writes the groups that it touches anew, with their open sessions.
GROUPS = 4096


def _packed(columns: list[np.ndarray], schema: pa.Schema) -> bytes:
    to = pa.BufferOutputStream()
    arrays = [pa.array(c, field.type, from_pandas=True) for c, field in zip(columns, schema, strict=True)]
    with pa.ipc.new_stream(to, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(pa.record_batch(arrays, schema=schema))
    return to.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[np.ndarray]:
    places, seq, ms, *items = (c.to_numpy() for c in pa.ipc.open_stream(data).read_all().columns)
    return [places, seq, ms, *(i.astype(object) for i in items)]


def _starts(places: np.ndarray) -> np.ndarray:
    """Where each session's rows start among rows in order of sessions."""
    return np.flatnonzero(np.diff(places, prepend=-1))


def in_order(calls: DataFrame, session: str, item: list[str], out: T.StructType, start: Any, step: Callable[..., tuple[tuple, Any]], late: dict, delay_ms: int, idle_ms: int, groups: int | None = None) -> DataFrame:
    """Rows of `out` for calls (session, seq, at, item), folded in the order of seq for each session.

    step(fold, *item) gives the answer's columns, in the order of `late`, and the next fold,
    which JSON can hold. Sessions are named by whole numbers or strings; items are strings
    or booleans. The watermark that Spark keeps lies HORIZON behind the latest event time, so
    that late calls reach this operator and can be answered; the delay is counted from there.
    A stream that goes on from a checkpoint must keep its number of groups.

    Calls go to Python and into the state as columns and are sorted and cut there by numpy;
    row by row there is only the step. Whole numbers that may be null travel as strings, as
    pandas has only doubles for them.
    """
    back, first = HORIZON_MS - delay_ms, json.dumps(start)
    marked = calls.withWatermark("at", f"{HORIZON_MS} milliseconds")
    group = F.pmod(F.xxhash64(session), F.lit(groups or GROUPS)).alias("_group")
    rows = marked.select(group, F.col(session).cast("string").alias("_name"), "seq", "at", F.unix_millis("at").alias("_ms"), *item)
    kinds = [pa.bool_() if isinstance(marked.schema[c].dataType, T.BooleanType) else pa.string() for c in item]
    schema = pa.schema([("_place", pa.int64()), ("seq", pa.int64()), ("_ms", pa.int64()), *zip(item, kinds, strict=True)])
    named = T.StructType([T.StructField(f.name, T.StringType() if f.name == session else f.dataType) for f in out.fields])

    def text(values: list) -> str:
        return json.dumps({c: v for c, v in zip(item, values, strict=True)}, separators=(",", ":"), ensure_ascii=False)

    def answered(sessions: list, columns: list[np.ndarray], answers: dict) -> pd.DataFrame:
        places, seq, _, *items = columns
        names = np.array([s[0] for s in sessions], dtype=object)[places]
        return pd.DataFrame({session: names, "seq": seq, **dict(zip(item, items, strict=True)), **answers}, columns=out.fieldNames())

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        mark = watermark + back
        sessions = json.loads(state.get[0]) if state.exists else []
        known = len(sessions)
        parts = [_unpacked(bytes(state.get[1])) if state.exists else [np.empty(0, np.int64)] * 3 + [np.empty(0, object)] * len(item)]
        if not state.hasTimedOut:
            place = {s[0]: i for i, s in enumerate(sessions)}
            last = np.array([s[2] if s[2] is not None else 0 for s in sessions])
            passed = np.array([s[2] is not None for s in sessions], bool)
            for batch in batches:
                places = np.array([place.setdefault(_plain(n), len(place)) for n in batch["_name"].tolist()], np.int64)
                sessions += [[n, json.loads(first), None, None] for n in islice(place, len(sessions), None)]
                columns = [places, batch["seq"].to_numpy(), batch["_ms"].to_numpy(), *(batch[c].astype(object).where(batch[c].notna(), None).to_numpy() for c in item)]
                gone = columns[2] <= mark
                if known:
                    old = np.minimum(places, known - 1)
                    gone |= (places < known) & passed[old] & (columns[1] <= last[old])
                if gone.any():
                    yield answered(sessions, [c[gone] for c in columns], late)
                    columns = [c[~gone] for c in columns]
                parts.append(columns)
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        places, seq, ms, *items = columns
        order = np.lexsort((ms, seq, places))
        same = np.diff(places[order]) == 0
        if (same & (np.diff(seq[order]) == 0) & (np.diff(ms[order]) == 0)).any():
            order = np.array(sorted(order.tolist(), key=lambda i: (places[i], seq[i], ms[i], text([c[i] for c in items]))))
        places, seq, ms, *items = columns = [c[order] for c in columns]
        heads = _starts(places)
        if len(heads):
            for i, at in zip(places[heads].tolist(), np.fmax.reduceat(ms, heads).tolist(), strict=True):
                if at == at:  # not where no call has a time
                    sessions[i][3] = int(at) if sessions[i][3] is None else max(int(at), sessions[i][3])
        # A call is ready unless it or one before it in its session lies beyond the mark.
        beyond = np.cumsum(ms > mark)
        before = np.repeat((beyond - (ms > mark))[heads], np.diff(heads, append=len(places)))
        ready = beyond == before
        if ready.any():
            done = [c[ready] for c in columns]
            answers, current, fold = [], None, None
            for i, *values in zip(*(c.tolist() for c in (done[0], *done[3:])), strict=True):
                if i != current:
                    if current is not None:
                        sessions[current][1] = fold
                    current, fold = i, sessions[i][1]
                answer, fold = step(fold, *values)
                answers.append(answer)
            sessions[current][1] = fold
            ends = np.append(_starts(done[0])[1:], len(done[0])) - 1
            for i, number in zip(done[0][ends].tolist(), done[1][ends].tolist(), strict=True):
                sessions[i][2] = number
            yield answered(sessions, done, dict(zip(late, zip(*answers, strict=True), strict=True)))
        places, seq, ms, *items = columns = [c[~ready] for c in columns]
        heads = _starts(places)
        turns = dict(zip(places[heads].tolist(), ms[heads].tolist(), strict=True))
        kept, moved, due = [], np.zeros(len(sessions), np.int64), None
        for i, one in enumerate(sessions):
            turn = turns.get(i, (one[3] or 0) + idle_ms)
            if turn > mark:
                moved[i] = len(kept)
                kept.append(one)
                due = turn if due is None else min(turn, due)
        if kept:
            state.update((json.dumps(kept), _packed([moved[places], *columns[1:]], schema)))
            # Spark calls again once its watermark is beyond this time, so as soon as the mark has reached the turn.
            state.setTimeoutTimestamp(max(int(due) - back - 1, watermark, 1))
        elif state.exists:
            state.remove()

    found = rows.groupBy("_group").applyInPandasWithState(run, named, HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*(F.col(f.name).cast(f.dataType) for f in out.fields))


ANSWERS = _fields(session_id=T.LongType(), seq=T.LongType(), answer=T.StringType())


def _retry(fold: list, key: str | None, finishes: bool | None) -> tuple[tuple, list]:
    owner, finished = fold
    owner = owner if owner is not None else key
    mine = owner is None or key == owner
    if finished:
        return ("replay" if key is not None and key == owner else "finished",), [owner, True]
    return ("proceed" if mine else "busy",), [owner, bool(mine and finishes)]


def retries(calls: DataFrame, delay_ms: int = 0, idle_ms: int = IDLE_MS) -> DataFrame:
    """The streaming twin of logs.retries over calls (session_id, seq, at, key, finishes): one owner and one outcome for each session."""
    return in_order(calls, "session_id", ["key", "finishes"], ANSWERS, [None, False], _retry, {"answer": "LATE"}, delay_ms, idle_ms)


STEPS = _fields(session_id=T.LongType(), seq=T.LongType(), action=T.StringType(), state=T.StringType(), answer=T.StringType())


def _step(state: str, action: str) -> tuple[tuple, str]:
    answer, then = logs.session_step(state, action)
    return (state, answer), then


def lifecycle(actions: DataFrame, delay_ms: int = 0, idle_ms: int = IDLE_MS) -> DataFrame:
    """The streaming twin of logs.session_answers over (session_id, seq, at, action): each action with the state that it finds and its answer.

    A closed session is remembered as such until it has been idle, so that late calls to it
    are refused and not taken for a new one's.
    """
    return in_order(actions, "session_id", ["action"], STEPS, "none", _step, {"state": None, "answer": "LATE"}, delay_ms, idle_ms)


class Once(StatefulProcessor):
    """Rows (id, content) of a group to (id, content, outcome): published, once an id; conflict, once a batch and content, for an id that is published with other content."""

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", _fields(id=T.StringType()), _fields(content=T.StringType()))

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        found: dict = {}
        for batch in rows:
            for name, content in batch[["id", "content"]].drop_duplicates().itertuples(index=False, name=None):
                found.setdefault(_plain(name), set()).add(_plain(content))
        out = []
        for name, contents in found.items():
            held = self.held.getValue((name,))
            if held is None:
                content = min(contents, key=lambda c: (c is not None, c or ""))
                self.held.updateValue((name,), (content,))
                out.append((name, content, "published"))
            else:
                content = held[0]
            out += [(name, c, "conflict") for c in contents if c != content]
        yield pd.DataFrame(out, columns=["id", "content", "outcome"], dtype=object)

    def handleInitialState(self, key, rows, timers) -> None:  # noqa: N802
        for name, content in rows[["id", "content"]].itertuples(index=False, name=None):
            self.held.updateValue((_plain(name),), (_plain(content),))

    def close(self) -> None:
        pass


def _plain(value: Any) -> str | None:
    return None if pd.isna(value) else value


def publication(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, content, outcome) of a stream (id, content), see Once.

    The content of each id is a state row of its own, so no batch reads what others have
    published and it writes no other ids' state; ids share GROUPS calls of Once a batch.
    `known` (id, content) is what a table held before the stream's first batch; it is read
    once, then. Of several contents of an id in its first batch the least counts, null first.
    """
    group = F.pmod(F.xxhash64("id"), F.lit(GROUPS)).alias("_group")
    once = rows.select(group, "id", "content").groupBy("_group")
    first = None if known is None else known.select(group, "id", "content").groupBy("_group")
    return once.transformWithStateInPandas(Once(), "id string, content string, outcome string", "append", "none", initialState=first)


def published(stream: DataFrame, path: str, conflicts: str, checkpoint: str, known: DataFrame | None = None) -> None:
    """Run the publication of a stream (id, content) over all there is now; a further run with its checkpoint adds nothing twice.

    The run is named after the checkpoint, as that is what a stream is known by.
    """
    run = "r" + uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            written(batch.filter("outcome = 'published'").drop("outcome"), path, run, number)
            written(batch.filter("outcome = 'conflict'").drop("outcome"), conflicts, run, number)
        finally:
            batch.unpersist()

    drained(publication(stream, known), sink, checkpoint=checkpoint)


def running_totals(episodes: DataFrame, *keys: str) -> DataFrame:
    """The streaming twin of scoring.totals, for output mode update: a batch gives the totals of the keys that it changed."""
    return scoring.totals(episodes, *keys)


def counters(decisions: DataFrame) -> DataFrame:
    """The streaming twin of logs.gate_counts by label."""
    return logs.gate_counts(decisions, "label")


def kept(path: str, run: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps every batch."""

    def sink(batch: DataFrame, number: int) -> None:
        written(batch, path, run, number)

    return sink


#: Batches after which changes are put together.
COMPACT = 50


def upserts(path: str, keys: list[str], run: str, compact: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """A sink for update mode: the rows that a batch changed, and now and then all keys together.

    A batch writes its own rows only. Every `compact` batches what the batches before have
    come to is written as a base, so a reader looks at one base and the changes after it.
    """

    def sink(batch: DataFrame, number: int) -> None:
        written(batch, f"{path}/changes", run, number)
        if number and number % compact == 0:
            written(latest(batch.sparkSession, path, keys, run, number), f"{path}/base", run, number)

    return sink


def latest(spark: SparkSession, path: str, keys: list[str], run: str, before: int | None = None) -> DataFrame:
    """The newest row of each key that a run has written (in batches below `before`)."""
    def own(name: str, schema: T.StructType | None) -> DataFrame:
        rows = stored(spark, f"{path}/{name}", schema).filter(F.col("run") == run)
        return rows if before is None else rows.filter(F.col("batch") < before)

    changes = own("changes", None)
    fields = T.StructType([f for f in changes.schema.fields if f.name not in ("run", "batch")])
    base = own("base", fields)
    # A base is newer than the changes it holds, so it stands at its own batch, less a half.
    newest = base.agg(F.max("batch")).first()[0]
    rows = changes.withColumn("_at", F.col("batch").cast("double"))
    if newest is not None:
        rows = rows.filter(F.col("batch") >= newest).unionByName(base.filter(F.col("batch") == newest).withColumn("_at", F.col("batch") - 0.5))
    rest = [f for f in fields.fieldNames() if f not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("_row")).select(*keys, "_row.*").select(*fields.fieldNames())
