"""Repair of damaged conversations by a shortest path over whole-number weights.

A repaired conversation has role initials `(s?(ua)+)?`: perhaps one system turn, then user
and assistant in turn. Edits turn a conversation into such a one: K keeps a row (0), R gives
it the role that has its turn (2), D deletes it (3; blank and repeated rows must go), I puts
an empty turn in (2); a row that is cut off costs 1 more unless deleted. The cheapest edits
win, and of these the one whose letters come first in ASCII.

The weight of an edit is one whole number: its cost in the high digits, and below it two
octal digits for each row, in which an insertion before the row (I) and the row's own letter
stand, filled up with zeros at the end. As every letter of a row but I ends the row's digits,
no row's digits begin another's, so numbers compare as costs, then audits do, and weights
just add up: the least sum over an acyclic graph of (row, last role) decides everything. More
than one insertion in a place never pays: the second would cost 2 to undo what the first did,
and a lone system turn is cheaper deleted (3) than followed by two (4).

Rows are dealt out by ranges of (conversation, turn, role, head of text), so a long conversation lies
in many tasks. A conversation inside one task is repaired there. Of others (two a task at
most) each piece of PIECE rows is reduced to the least sums from each last role to each; these
are chained, which needs only costs and the order of audits (audits of different last roles
differ, and none begins another); then pieces are repaired each for itself. First sights of
(role, text) across tasks are minima with partial sums. No task holds more than PIECE rows of
a conversation in more than one task, or its own rows.

Defined cases: nulls count as one blank, but a null turn is a turn of its own, before all
others, and no number for gaps; rows with one turn are in the order of role, text; a null
conv_id is a conversation; only the first letter of a role counts, and the empty role has
none; an empty table gives no rows; very long texts are never cut; columns besides the four
named are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settled

#: Rows of a long conversation that are repaired at a time.
PIECE = 512
#: First sights that many rows may ask for are held so many times.
SALTS = 16
BATCH_BYTES = 4_000_000
#: Letters of the audit as octal digits, in ASCII order.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
#: The last role of what is repaired so far: none yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\v\f\r"

Row = tuple[int | None, str, str, bool]  # turn, role, text, seen in an earlier task


def fault(role: str, text: str, seen: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    body = text.strip(BLANKS)
    if not body:
        return "blank"
    return "duplicate" if seen else "" if body[-1] in ".!?" else "truncated"


def faults(rows: list[Row], known: set | None = None) -> list[str]:
    """The fault of each row; known are the (role, text) seen so far."""
    known, out = set() if known is None else known, []
    for _, role, text, seen in rows:
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        out.append(fault(role, text, seen or key in known))
        known.add(key)
    return out


def edits(state: int, initial: str) -> Iterator[tuple[str, int]]:
    """(letters, new state) of what may be done with a row, but for deletion."""
    for letters, at in (("", state), ("I", NEXT[state])):
        to = {"u": USER, "a": ASSISTANT}.get(initial, -1)
        if NEXT[at] == to or (initial == "s" and at == NONE):
            yield letters + "K", to if to == NEXT[at] else SYSTEM
        yield letters + "R", NEXT[at]


def least_paths(initials: list[str], found: list[str], start: int) -> tuple[list[int | None], list[dict]]:
    """Least sums to each state after all rows, and for each row the edits that led to it."""
    n = len(initials)
    now: list[int | None] = [None] * 4
    now[start] = 0
    back = []
    for i, (initial, what) in enumerate(zip(initials, found, strict=True)):
        then: list[int | None] = [None] * 4
        came: dict[int, tuple[int, str]] = {}
        for state, total in enumerate(now):
            if total is None:
                continue
            ways = [("D", state), ("ID", NEXT[state])]
            if what in ("", "truncated"):
                ways += edits(state, initial)
            for letters, to in ways:
                cost = sum(COST[x] for x in letters) + (what == "truncated" and letters[-1] != "D")
                digits = (DIGIT[letters[0]] << 3) + (DIGIT[letters[1]] if len(letters) > 1 else 0)
                weight = total + (cost << 6 * n) + (digits << 6 * (n - 1 - i))
                if then[to] is None or weight < then[to]:
                    then[to], came[to] = weight, (state, letters)
        now = then
        back.append(came)
    return now, back


def walked(back: list[dict], state: int) -> list[str]:
    """The letters of each row on the least path to a state."""
    out = []
    for came in reversed(back):
        state, letters = came[state]
        out.append(letters)
    return out[::-1]


def turns(rows: list[Row], letters: list[str], start: int) -> list[tuple[str, str]]:
    """The repaired (role, text)."""
    out, state = [], start
    for (_, role, text, _), own in zip(rows, letters, strict=True):
        for x in own:
            if x == "D":
                continue
            if x == "K":
                out.append((role, text))
                state = SYSTEM if role[:1] == "s" else NEXT[state]
            else:
                state = NEXT[state]
                out.append((ROLE[state], text if x == "R" else ""))
    return out


def summary(rows: list[Row], found: list[str], starts: list[int]) -> dict:
    """What chaining needs to know of a piece: least sums as costs and ranks of audits, and counts."""
    initials = [r[1][:1] for r in rows]
    low = (1 << 6 * len(rows)) - 1
    sums = {(p, q): v for p in starts for q, v in enumerate(least_paths(initials, found, p)[0]) if v is not None}
    rank = {a: i for i, a in enumerate(sorted({v & low for v in sums.values()}))}
    numbers = [r[0] for r in rows if r[0] is not None]
    return {
        "paths": [(p, q, v >> 6 * len(rows), rank[v & low]) for (p, q), v in sums.items()],
        "counts": [found.count(x) for x in ("blank", "duplicate", "truncated")],
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "ends": (initials[0], initials[-1]) if rows else None,
        "turns": (numbers[0], numbers[-1], len(set(numbers))) if numbers else None,
    }


def chained(pieces: list[dict]) -> tuple[list[tuple[int, int]], bool, dict]:
    """(first state, last state) of each piece on the cheapest path, whether a turn is put in at the end, and totals."""
    cost, rank, steps = {NONE: 0}, {NONE: 0}, []
    for piece in pieces:
        best: dict[int, tuple] = {}
        for p, q, more, own in piece["paths"]:
            if p in cost and (q not in best or (cost[p] + more, rank[p], own) < best[q][0]):
                best[q] = ((cost[p] + more, rank[p], own), p)
        order = sorted({b[0][1:] for b in best.values()})
        cost, rank = {q: b[0][0] for q, b in best.items()}, {q: order.index(b[0][1:]) for q, b in best.items()}
        steps.append({q: b[1] for q, b in best.items()})
    ends = [(cost[q] + COST["I"] * (q == USER), rank[q], q) for q in cost if q != SYSTEM]
    total, _, state = min(ends)
    added, path = state == USER, []
    for step in reversed(steps):
        path.append((step[state], state))
        state = step[state]
    spans = [p["turns"] for p in pieces if p["turns"]]
    distinct = sum(t[2] for t in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    ended = [p["ends"] for p in pieces if p["ends"]]
    counts = [sum(p["counts"][k] for p in pieces) for k in range(3)]
    illegal = sum(p["illegal"] for p in pieces) + sum(a[1] + b[0] not in LEGAL for a, b in zip(ended, ended[1:], strict=False))
    gaps = spans[-1][1] - spans[0][0] + 1 - distinct if spans else 0
    return path[::-1], added, dict(zip(_TOTALS, (gaps, *counts, illegal, total), strict=True))


_TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired_piece(rows: list[Row], found: list[str], path: tuple[int, int], added: bool) -> tuple[str, list[tuple[str, str]]]:
    """Audit and turns of a piece."""
    _, back = least_paths([r[1][:1] for r in rows], found, path[0])
    letters = walked(back, path[1])
    out = turns(rows, letters, path[0])
    if added:
        out.append((ROLE[NEXT[path[1]]], ""))
    return "".join(letters) + "I" * added, out


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _pieces(rows: list) -> list[list]:
    return [rows[i : i + PIECE] for i in range(0, len(rows), PIECE)] or [[]]


class _Out:
    """Rows (conv_id, piece, pieces, audit, turns, totals) as Arrow batches of bounded size."""

    def __init__(self, key: pa.DataType):
        self.key, self.rows, self.size = key, [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.size += 100 + len(row[3]) + sum(len(t) + 20 for _, t in row[4])

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or self.size > BATCH_BYTES):
            columns = list(zip(*self.rows, strict=True))
            totals = [pa.array([r[name] for r in columns[5]], pa.int64()) for name in _TOTALS]
            told = pa.array([[{"role": a, "text": b} for a, b in t] for t in columns[4]], _TURNS)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], self.key), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), told, *totals], ["conv_id", "piece", "pieces", "audit", "turns", *_TOTALS])
            self.rows, self.size = [], 0


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def damaged(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): by the checksum of `conv_id:turn`, a row in twenty each is dropped, emptied, robbed of its ends of sentences, repeated or given the role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return convs.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.explode(copies).alias("_copy")).drop("_copy")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, pieces, audit, turns, gaps, blank, duplicate, truncated, illegal, cost) of every conversation in (conv_id, turn, role, text, dropped).

    A conversation has one row, or, where its rows lie in several tasks, one for each piece,
    with the totals of the whole conversation on each; rows that are `dropped` only name it.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "text"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Heads of texts bound what the sample of the ranges holds; they sort as texts do.
    dealt = settled(rows.repartitionByRange(n, *order[:3], F.substring("text", 1, 32)).sortWithinPartitions(*order).select(*order, "dropped"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column("conv_id").slice(0, 1) if first is None else first
                last = batch.column("conv_id").slice(batch.num_rows - 1, 1)
        if first is not None:
            own = pa.concat_arrays([first] if first.equals(last) else [first, last])
            yield pa.RecordBatch.from_arrays([own, pa.array([TaskContext.get().partitionId()] * len(own), pa.int32())], ["conv_id", "part"])

    # Conversations in more than one task: at most two for each task.
    broken = dealt.select("conv_id").mapInArrow(ends, f"conv_id {kind}, part int").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cut = spark.sparkContext.broadcast({r.conv_id for r in broken.toLocalIterator()})
    out = f"conv_id {kind}, piece long, pieces long, audit string, turns array<struct<role: string, text: string>>, {', '.join(f'{t} long' for t in _TOTALS)}"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        result = None
        key_type: list[pa.DataType] = []

        def seen(bs):
            for b in bs:
                key_type[:] = [b.schema.field("conv_id").type]
                yield b

        for conv, found in groupby(_rows(seen(batches), "conv_id", "turn", "role", "text", "dropped"), key=lambda r: r[0]):
            if conv in cut.value:
                continue
            result = result or _Out(key_type[0])
            pieces = _pieces([(t, role, text, False) for _, t, role, text, dropped in found if not dropped])
            known: set = set()
            told = [faults(p, known) for p in pieces]
            path, added, totals = chained([summary(p, f, [NONE] if not i else [0, 1, 2, 3]) for i, (p, f) in enumerate(zip(pieces, told, strict=True))])
            done = [repaired_piece(p, f, s, added and i == len(pieces) - 1) for i, (p, f, s) in enumerate(zip(pieces, told, path, strict=True))]
            result.add(conv, 0, 1, "".join(a for a, _ in done), [t for _, ts in done for t in ts], totals)
            yield from result.batches()
        if result:
            yield from result.batches(last=True)

    one_task = dealt.mapInArrow(whole, out)
    if not cut.value:
        return one_task

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of broken conversations with the place of their piece."""
        part, last, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            kept, place = [], []
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                at = at + 1 if conv == last else 0
                last = conv
                if conv in cut.value:
                    kept.append(i)
                    place.append((part << 40) + at)
            if kept:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])

    seen_key = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("conv_id").isNull().cast("string"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    long = settled(dealt.mapInArrow(placed, f"conv_id {kind}, turn long, role string, text string, dropped boolean, place long").withColumn("key", seen_key))
    live = long.filter("not dropped")
    firsts = live.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    piece = F.expr(f"place - pmod(place, {PIECE})")
    flagged = live.withColumn("salt", F.pmod("place", F.lit(SALTS)).cast("int")).join(firsts, ["key", "salt"], "left").select("conv_id", piece.alias("piece"), "place", "turn", "role", "text", (F.col("first") < F.col("place")).alias("seen"))
    flagged = settled(flagged.withColumn("seen", F.coalesce("seen", F.lit(False))).repartition("piece").sortWithinPartitions("piece", "conv_id", "place"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[Row]]]:
        for key, found in groupby(_rows(batches, "piece", "conv_id", "turn", "role", "text", "seen"), key=lambda r: r[:2]):
            yield key, [r[2:] for r in found]

    paths = pa.list_(pa.list_(pa.int64()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _with_type(told, batches):
            (at, conv), rows, key = batch
            s = summary(rows, faults(rows), [0, 1, 2, 3])
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], key), pa.array([at], pa.int64()), pa.array([s["paths"]], paths), pa.array([s["counts"]], pa.list_(pa.int64())), pa.array([s["illegal"]], pa.int64()), pa.array([s["ends"]], pa.list_(pa.string())), pa.array([s["turns"]], pa.list_(pa.int64()))],
                ["conv_id", "piece", "paths", "counts", "illegal", "ends", "turns"],
            )

    sums = flagged.mapInArrow(summed, f"conv_id {kind}, piece long, paths array<array<long>>, counts array<long>, illegal long, ends array<string>, turns array<long>")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row of some hundred bytes for each piece of a conversation."""
        for found in _by_conv(batches):
            conv, key, pieces = found
            path, added, totals = chained([{**p, "paths": [tuple(x) for x in p["paths"]]} for p in pieces])
            n = len(pieces)
            columns = [pa.array([conv] * n, key), *(pa.array(x, pa.int64()) for x in ([p["piece"] for p in pieces], range(n), [n] * n, [a for a, _ in path], [b for _, b in path], [int(added and i == n - 1) for i in range(n)], *([totals[t]] * n for t in _TOTALS)))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "at", "piece", "pieces", "first", "last", "added", *_TOTALS])

    chain = settled(sums.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(linked, f"conv_id {kind}, at long, piece long, pieces long, first long, last long, added long, {', '.join(f'{t} long' for t in _TOTALS)}"))
    steps = F.struct("piece", "pieces", "first", "last", "added", *_TOTALS)
    ways = chain.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), steps.alias("step"))
    joined = flagged.join(ways, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_at"))).drop("_conv", "_at")
    joined = joined.repartition("piece").sortWithinPartitions("piece", "conv_id", "place")

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        result, key = None, None
        names = ("piece", "conv_id", "step", "turn", "role", "text", "seen")

        def typed(bs):
            nonlocal key
            for b in bs:
                key = b.schema.field("conv_id").type
                yield b

        for (_, conv), found in groupby(_rows(typed(batches), *names), key=lambda r: r[:2]):
            found = list(found)
            result, step, rows = result or _Out(key), found[0][2], [r[3:] for r in found]
            audit, said = repaired_piece(rows, faults(rows), (step["first"], step["last"]), bool(step["added"]))
            result.add(conv, step["piece"], step["pieces"], audit, said, step)
            yield from result.batches()
        if result:
            yield from result.batches(last=True)

    # Conversations of which all rows were dropped.
    named = chain.select(F.col("conv_id").alias("_conv")).distinct()
    empty = long.select("conv_id").distinct().join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti")
    none = empty.select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces"), F.lit("").alias("audit"), F.array().cast("array<struct<role: string, text: string>>").alias("turns"), *[F.lit(0).cast("long").alias(t) for t in _TOTALS])
    return one_task.union(joined.mapInArrow(mended, out)).union(none)


def _with_type(told, batches: Iterator[pa.RecordBatch]):
    """Groups of told(batches) with the Arrow type of conv_id."""
    key: list[pa.DataType] = []

    def typed():
        for b in batches:
            key[:] = [b.schema.field("conv_id").type]
            yield b

    for group, rows in told(typed()):
        yield group, rows, key[0]


def _by_conv(batches: Iterator[pa.RecordBatch]):
    """(conv_id, its Arrow type, summaries) from rows in the order of conversation and piece."""
    key: list[pa.DataType] = []

    def rows():
        for b in batches:
            key[:] = [b.schema.field("conv_id").type]
            yield from b.to_pylist()

    for conv, found in groupby(rows(), key=lambda r: r["conv_id"]):
        yield conv, key[0], list(found)


def digested(pieces: DataFrame) -> DataFrame:
    """One row a conversation: totals, audit and SHA-256 of the repaired `role:text` lines.

    A hash runs over a conversation from its first turn to its last, so the pieces of a long
    one stream through one task; nothing but the audit is held.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = pieces.filter("pieces = 1").select("conv_id", *_TOTALS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    parted = pieces.filter("pieces > 1").select("conv_id", "piece", *_TOTALS, "audit", F.size("turns").alias("n"), lines.alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None

        def rows():
            nonlocal key
            for b in batches:
                key = b.schema.field("conv_id").type
                yield from _rows([b], "conv_id", "audit", "n", "lines", *_TOTALS)

        for conv, found in groupby(rows(), key=lambda r: r[0]):
            digest, audits, begun, totals = hashlib.sha256(), [], False, None
            for _, audit, n, text, *totals in found:  # noqa: B007
                audits.append(audit)
                if n:
                    digest.update((b"\n" if begun else b"") + text.encode())
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array([conv], key), *(pa.array([t], pa.int64()) for t in totals), pa.array(["".join(audits)]), pa.array([digest.hexdigest()])], ["conv_id", *_TOTALS, "audit", "repaired_sha256"])

    kind = pieces.schema["conv_id"].dataType.simpleString()
    streamed = parted.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, f"conv_id {kind}, {', '.join(f'{t} long' for t in _TOTALS)}, audit string, repaired_sha256 string")
    return whole.union(streamed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digested(settled(repaired(damaged(convs))))
