"""Language-model scores by context-tree weighting over bytes, beside a word-count baseline.

A text is lower-cased (A-Z), cut into words and written as its words with single blanks
between them and a line feed at the end: bytes and tokens (words and one end) say the same.
The model (context_tree) counts bytes in contexts of up to DEPTH bytes over all training
rows, and gives every text its log10 probability and its code length per byte. The baseline
counts tokens over the same rows.

Neither counts nor vocabulary go through one task or the driver. A task reduces a block of
about BLOCK_BYTES of text to its distinct grams and tokens and sends each shard those that
the shard owns: grams by the last two bytes of context and three bits of the third, so that
a frequent pair of bytes lies in several shards and a shard holds whole subtrees of
contexts; tokens by a checksum. What blocks send to a shard is added up as it streams by,
first in parts of about PART_BYTES, then the parts' sums. Shards put their trees together
from level TOP + 1 on; the levels above (one node for each pair of bytes seen and each of
255 decisions, 16.7 million at most and some 100,000 for text of a few languages) are
summed by Spark, finished on the driver and broadcast. Then parts of what was sent stream
by the shard's trees and get the chances of grams and the counts of tokens as answers, and
blocks score their documents with these. No task holds more than a shard's sums, some
ANSWER_AT grams of requests, and a block. What blocks send is written once to the shared
checkpoint folder, so a lost executor repeats its own part only.

Defined cases: a null text is the empty text, whose one token is the end; without training
rows every byte costs eight bits and the baseline is 0; rows are scored one by one, equal
rows alike, also with a null doc_id (which counts as the empty string for the fold); an
empty table gives no rows; columns of the input other than the two named are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree as ctw
from .shared import chunks, held_out, settled

FOLDS, HELD_OUT_FOLD = 7, 2
BLOCK_BYTES = 16_000_000
STEP_BYTES = 2_000_000
MERGE_AT = 4_000_000
#: What a shard is sent is dealt out in parts of about so many bytes.
PART_BYTES = 64_000_000
#: So many grams of requests are answered at a time.
ANSWER_AT = 2_000_000
#: The deepest level that is put together for all shards.
TOP = 2
GRAMS, TOKENS, TEXTS = 0, 1, 2
#: Token that ends a text; no word holds a line feed.
END = b"\n"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, the first one in ascending order, byte planes compressed."""
    first = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in (first, *columns[1:])]
    return np.array([len(first)], np.int64).tobytes() + zstandard.compress(b"".join(planes), 1)


def _pack_values(values: np.ndarray) -> bytes:
    """Doubles, byte planes compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), 8).T).tobytes(), 1)


def _unpack_values(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).reshape(-1).view(float)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    raw, at, out = zstandard.decompress(data[8:]) if n else b"", 0, []
    for kind in (np.uint64, *kinds):
        size = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(kind))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def bodies(texts: list[str | None]) -> list[bytes]:
    return [b" ".join((t or "").encode().lower().split()) + END for t in texts]


def grams_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts, one for each byte, and where each text begins among them."""
    pad = bytes([ctw.EDGE]) * ctw.DEPTH
    sizes = np.array([len(p) for p in parts], np.int64)
    stream = np.frombuffer(pad + pad.join(parts), np.uint8)
    keep = np.ones(len(stream) - ctw.DEPTH, bool)
    ends = np.cumsum(sizes + ctw.DEPTH)[:-1] - ctw.DEPTH
    keep[(ends[:, None] + np.arange(ctw.DEPTH)).reshape(-1)] = False
    return ctw.packed(stream)[keep], np.cumsum(sizes) - sizes


def gram_shard(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the last two bytes of context and three bits of the third one."""
    ends = grams >> np.uint64(8 * (ctw.DEPTH - 2))
    ends &= np.uint64(0xFFFF07)
    return (((ends * np.uint64(2654435761)) >> np.uint64(12)) & np.uint64(0xFFFFF)).astype(np.int64) % shards


def by_shard(grams: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its grams in order) for each shard that has some."""
    owner = gram_shard(grams, shards)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=shards))
    for s, (first, last) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        if last > first:
            yield s, order[first:last]


def distinct(parts: list[bytes]) -> np.ndarray:
    """All grams of the texts, each once, in order."""
    held: list[np.ndarray] = []
    for a, b in _steps([len(p) for p in parts]):
        held.append(np.unique(grams_of(parts[a:b])[0]))
        if sum(map(len, held)) > MERGE_AT:
            held = [np.unique(np.concatenate(held))]
    return np.unique(np.concatenate(held))


def _steps(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP_BYTES."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= STEP_BYTES:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return ctw.counted(np.concatenate([g for g, _ in held]), np.concatenate([c for _, c in held]))


def sent(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """(block, kind, shard, payload): what each block sends to shards, and keeps of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, table in enumerate(chunks(batches, "text", BLOCK_BYTES)):
            block = (task << 32) + number
            held = table.column("held_out").to_numpy()
            parts = bodies(table.column("text").to_pylist())
            tokens: Counter[bytes] = Counter()
            grams: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in _steps([len(p) for p in parts]):
                for out in (False, True):
                    some = [p for p, h in zip(parts[a:b], held[a:b], strict=True) if h == out]
                    if not some:
                        continue
                    found, n = ctw.counted(grams_of(some)[0])
                    grams.append((found, n * (not out)))
                    words = b" ".join(some).split()
                    if out:
                        tokens.update(dict.fromkeys(words, 0))
                        tokens[END] += 0
                    else:
                        tokens.update(words)
                        tokens[END] += len(some)
                if sum(len(g) for g, _ in grams) > MERGE_AT:
                    grams = [_merged(grams)]
            found, n = _merged(grams)
            rows = []
            for s, at in by_shard(found, shards):
                rows.append((GRAMS, s, pack(found[at], n[at].astype(np.int64))))
            owned: list[list[bytes]] = [[] for _ in range(shards)]
            for t in tokens:
                owned[zlib.crc32(t) % shards].append(t)
            for s, own in enumerate(owned):
                if own:
                    rows.append((TOKENS, s, _pack_tokens(own, np.array([tokens[t] for t in own], np.int64))))
            ids = pa.RecordBatch.from_arrays([table.column(c).combine_chunks() for c in ("doc_id", "held_out")], ["doc_id", "held_out"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as writer:
                writer.write_batch(ids)
            lengths = np.array([len(p) for p in parts], np.int64).tobytes()
            head = np.array([len(parts), sink.tell()], np.int64).tobytes()
            rows.append((TEXTS, -1, head + lengths + sink.getvalue().to_pybytes() + zstandard.compress(b"".join(parts), 3)))
            for kind, shard, payload in rows:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([payload], pa.binary())], ["block", "kind", "shard", "payload"])

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), held_out(docs[key], FOLDS, HELD_OUT_FOLD).alias("held_out"))
    return rows.mapInArrow(run, "block long, kind int, shard int, payload binary")


def _pack_tokens(tokens: list[bytes], counts: np.ndarray) -> bytes:
    return np.array([len(tokens)], np.int64).tobytes() + zstandard.compress(counts.tobytes() + b" ".join(t if t != END else b"" for t in tokens), 1)


def _unpack_tokens(data: bytes) -> tuple[list[bytes], np.ndarray]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    raw = zstandard.decompress(data[8:])
    return [t or END for t in raw[8 * n :].split(b" ")], np.frombuffer(raw, np.int64, n)


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in columns)


_SUMS = ["shard", "kind", "payload"]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (shard, part) to the sums of each: (shard, kind, payload) of grams and tokens that training rows have."""
    for (shard, _), rows in groupby(_rows(batches, "shard", "part", "kind", "payload"), key=lambda r: r[:2]):
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        tokens: Counter = Counter()
        for _, _, kind, payload in rows:
            if kind == GRAMS:
                g, n = unpack(payload, np.int64)
                if n.any():
                    grams.append((g[n > 0], n[n > 0]))
                if sum(len(g) for g, _ in grams) > MERGE_AT:
                    grams = [_merged(grams)]
            else:
                own, n = _unpack_tokens(payload)
                for t, c in zip(own, n.tolist(), strict=True):
                    if c:
                        tokens[t] += c
        if grams:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([GRAMS], pa.int32()), pa.array([pack(*_merged(grams))], pa.binary())], _SUMS)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([TOKENS], pa.int32()), pa.array([_pack_tokens(list(tokens), np.fromiter(tokens.values(), np.int64, len(tokens)))], pa.binary())], _SUMS)


def _trees(payload: bytes | None) -> list[ctw.Level]:
    grams, n = unpack(payload, np.int64) if payload else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return ctw.levels(grams, n, TOP + 1)


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for level TOP, by node; under key -1 the tokens and the distinct tokens of training."""
    for kind, payload in _rows(batches, "kind", "payload"):
        if kind == GRAMS:
            keys, n0, n1, product = ctw.grouped_by_parent(_trees(payload)[0])
        else:
            n = _unpack_tokens(payload)[1]
            keys, n0, n1, product = np.array([-1]), np.array([n.sum()], float), np.array([len(n)], float), np.zeros(1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.astype(np.int64), n0, n1, product)], ["key", "n0", "n1", "product"])


def _answered(batches: Iterator[pa.RecordBatch], top: list[ctw.Level]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (shard, part), the shard's sums first, to answers (block, kind, shard, payload)."""
    names, kinds = ["block", "kind", "shard", "payload"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    as_batch = lambda *row: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)
    for (shard, _), rows in groupby(_rows(batches, "shard", "part", "request", "kind", "block", "payload"), key=lambda r: r[:2]):
        sums: bytes | None = None
        total: dict[bytes, int] = {}
        trees: list[ctw.Level] | None = None
        waiting: list[tuple[int, np.ndarray]] = []

        def answers(shard=shard) -> Iterator[pa.RecordBatch]:
            every = np.unique(np.concatenate([g for _, g in waiting]))
            chances = ctw.log_chances(every, trees)
            for block, grams in waiting:
                yield as_batch(block, GRAMS, shard, _pack_values(chances[np.searchsorted(every, grams)]))
            waiting.clear()

        for _, _, request, kind, block, payload in rows:
            if not request and kind == GRAMS:
                sums = payload
            elif not request:
                own, n = _unpack_tokens(payload)
                total = dict(zip(own, n.tolist(), strict=True))
            elif kind == GRAMS:
                trees = trees or top + _trees(sums)
                waiting.append((block, unpack(payload, np.int64)[0]))
                if sum(len(g) for _, g in waiting) > ANSWER_AT:
                    yield from answers()
            else:
                own, _ = _unpack_tokens(payload)
                yield as_batch(block, TOKENS, shard, _pack_tokens(own, np.array([total.get(t, 0) for t in own], np.int64)))
        if waiting:
            yield from answers()


class Lookup:
    """Values of 64-bit keys by hashing; keys that collide go on to the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        multiplier = 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(4, int(2 * len(keys) - 1).bit_length() + 1)
            table = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
            held = np.zeros(1 << bits)
            at = (keys * np.uint64(multiplier)) >> np.uint64(64 - bits)
            table[at], held[at] = keys, values
            self.tables.append((np.uint64(multiplier), np.uint64(64 - bits), table, held))
            lost = table[at] != keys
            keys, values = keys[lost], values[lost]
            multiplier = (multiplier * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        left = None
        for multiplier, shift, table, held in self.tables:
            now = keys if left is None else keys[left]
            at = (now * multiplier) >> shift
            found = table[at] == now
            if left is None:
                out = held[at]
                left = np.flatnonzero(~found)
            else:
                out[left[found]] = held[at[found]]
                left = left[~found]
            if not len(left):
                break
        return out


def _scored(rows: pd.DataFrame, total: int, distinct_tokens: int, shards: int) -> pd.DataFrame:
    """A block's documents with their scores, from the answers of all shards."""
    data = rows["payload"][rows["kind"] == TEXTS].iloc[0]
    n, meta = np.frombuffer(data[:16], np.int64).tolist()
    sizes = np.frombuffer(data, np.int64, n, 16)
    ids = pa.ipc.open_stream(data[16 + 8 * n : 16 + 8 * n + meta]).read_all()
    raw = zstandard.decompress(data[16 + 8 * n + meta :])
    ends = np.cumsum(sizes)
    texts = [raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
    grams = distinct(texts)
    chances = np.zeros(len(grams))
    answers = {s: p for k, s, p in zip(rows["kind"], rows["shard"], rows["payload"], strict=True) if k == GRAMS}
    for s, at in by_shard(grams, shards):
        chances[at] = _unpack_values(answers[s])
    lookup = Lookup(grams, chances)
    logs: dict[bytes, float] = {}
    for own, c in (_unpack_tokens(p) for k, p in zip(rows["kind"], rows["payload"], strict=True) if k == TOKENS):
        logs.update(zip(own, np.log10(c + 1.0).tolist(), strict=True))
    score, base, n_tokens, n_known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a, b in _steps(sizes.tolist()):
        found, starts = grams_of(texts[a:b])
        score[a:b] = np.add.reduceat(lookup(found), starts)
        for i, part in enumerate(texts[a:b], a):
            words = part.split()
            own = np.fromiter(map(logs.__getitem__, words), float, len(words))
            end = logs[END]
            base[i], n_tokens[i], n_known[i] = own.sum() + end, len(words) + 1, np.count_nonzero(own) + (end > 0)
    base -= n_tokens * np.log10(total + distinct_tokens + 1.0)
    frame = ids.to_pandas(types_mapper=pd.ArrowDtype)
    return frame.assign(n_tokens=n_tokens, n_known=n_known, train_tokens=total, base_score=base, score=score / np.log(10), bits_per_byte=-score / np.log(2) / sizes)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    spark = docs.sparkSession
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(sent(docs, key, text, shards))
    asked = rows.filter(F.col("kind") != TEXTS)
    # A row for each shard.
    parts = asked.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("payload")) / PART_BYTES).cast("int").alias("parts"))
    dealt = asked.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts").cast("long")).cast("int"))
    schema = "shard int, kind int, payload binary"
    added = dealt.select("shard", "part", "kind", "payload").repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(_added, schema)
    sums = settled(added.withColumn("part", F.lit(0)).repartition("shard").sortWithinPartitions("shard").mapInArrow(_added, schema))
    # At most 2^24 nodes by their keys, and one row of totals.
    top = sums.mapInArrow(_top, "key long, n0 double, n1 double, product double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "product")]).orderBy("key").toArrow()
    keys, n0, n1, product = (top.column(c).to_numpy() for c in ("key", "n0", "n1", "product"))
    nodes = keys >= 0
    total, distinct_tokens = int(n0[~nodes].sum()), int(n1[~nodes].sum())
    levels = spark.sparkContext.broadcast(ctw.top_levels(keys[nodes].astype(np.uint64), n0[nodes], n1[nodes], product[nodes], TOP))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _answered(batches, levels.value)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return _scored(pdf, total, distinct_tokens, shards)

    columns = ["shard", "part", "request", "kind", "block", "payload"]
    given = sums.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("request", F.lit(False)).withColumn("block", F.lit(0).cast("long")).select(*columns)
    requests = dealt.withColumn("request", F.lit(True)).select(*columns)
    answers = given.union(requests).repartition("shard", "part").sortWithinPartitions("shard", "part", "request").mapInArrow(answer, "block long, kind int, shard int, payload binary")
    kind = docs.schema[key].dataType.simpleString()
    gathered = answers.union(rows.filter(F.col("kind") == TEXTS).select("block", "kind", "shard", "payload"))
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return gathered.groupBy("block").applyInPandas(score, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
