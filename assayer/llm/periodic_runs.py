"""Stretches of words that repeat themselves at once: all runs of a text.

A run is a stretch of words with a smallest period q (words q apart are equal), at least
max(LEAST, 2q) words long, that no neighbouring word extends with that period.

Runs are found by internal pattern matching. A run of m + q words with period q repeats its
first m words q places on; of these m words an aligned (dyadic) block of b words is part, with
b a power of two and q < 4b - 1. So for every level b, each aligned block asks for its
occurrences in the 4b words after it: the suffixes that begin with the block are a range of
the suffix array, and the next of them in the text is a range successor in a wavelet tree over
it. Occurrences nearer than b are a progression whose difference is the period of the block
itself; where this periodic stretch ends is one comparison of suffixes away, and the search
goes on behind it, as farther members of the same progression are multiples of the period.
Every occurrence found gives a candidate period, which common prefixes to both sides (Kasai,
least of a range) extend to a maximal stretch; of equal stretches the least period stays.

Every word of a run lies in some GRAM words that occur twice in the text, so only stretches
covered by such grams go into the suffix array; this loses nothing.

Every text stays in the task that reads it: there is no shuffle, a lost task is just run
again, and memory is bounded by the chunk (CHUNK_BYTES, or one text if longer).

Defined cases: words are what ASCII white space separates; a null or empty text has no words
and no runs; repeated rows get the same result each; an empty table gives no rows; other
columns are carried along, but one with a result's name gives way to it. For damage a null
doc_id is the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACES, bound, chunks
from .suffixes import common_prefixes, left_in_part, suffix_array

LEAST = 12
#: A run of LEAST words or more repeats its first LEAST / 2 words at least.
GRAM = LEAST // 2
CHUNK_BYTES = 1_000_000


class Words(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class LeastOf:
    """Least value of ranges, by a table of ranges of all powers of two."""

    def __init__(self, values: np.ndarray):
        rows, n = [values.astype(np.int32)], len(values)
        while 2 << (len(rows) - 1) <= n:
            half = 1 << (len(rows) - 1)
            last = rows[-1]
            rows.append(np.concatenate((np.minimum(last[:-half], last[half:]), last[-half:])))
        self.table = np.stack(rows)
        self.level = np.zeros(n + 1, np.int8)
        for k in range(1, len(rows)):
            self.level[1 << k :] = k

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the values from first to last, both included."""
        k = self.level[last - first + 1]
        return np.minimum(self.table[k, first], self.table[k, last + 1 - (1 << k.astype(np.int64))])


class Suffixes:
    """Suffixes of parts of an array, and what two of them have in common."""

    def __init__(self, values: np.ndarray, left: np.ndarray):
        self.order, self.rank = suffix_array(values, left)
        self.shared = common_prefixes(self.order, values, left)
        self.least = LeastOf(self.shared)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Values that different suffixes i and j begin with in common."""
        a, b = self.rank[i], self.rank[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


class WaveletTree:
    """Range successors in a permutation: bit by bit from the highest, zeros before ones at each level."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.before: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            zero = (values >> bit) & 1 == 0
            self.before.append(np.concatenate(([0], np.cumsum(zero))).astype(np.int32))
            values = np.concatenate((values[zero], values[~zero]))

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least value of values[low:high] that is `least` or more; -1 where there is none."""
        a, b, below = low, high, np.zeros(len(low), np.int64)
        for before, bit in zip(self.before, reversed(range(self.bits)), strict=True):
            one = (least >> bit) & 1 == 1
            za, zb = before[a], before[b]
            below += np.where(one, zb - za, 0)
            a, b = np.where(one, before[-1] + a - za, za), np.where(one, before[-1] + b - zb, zb)
        none = (below >= high - low) | (least >> self.bits > 0)
        a, b, left, found = low, high, np.where(none, 0, below), np.zeros(len(low), np.int64)
        for before, bit in zip(self.before, reversed(range(self.bits)), strict=True):
            za, zb = before[a], before[b]
            one = left >= zb - za
            left = np.where(one, left - (zb - za), left)
            found += one.astype(np.int64) << bit
            a, b = np.where(one, before[-1] + a - za, za), np.where(one, before[-1] + b - zb, zb)
        return np.where(none, -1, found)


def covered(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each word lies in GRAM words that its text holds twice; text ascends."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(len(words), bool)
    key = text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(GRAM):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n].astype(np.uint64)
        key ^= key >> np.uint64(29)
    at = np.flatnonzero(text[:n] == text[GRAM - 1 :])
    order = at[np.argsort(key[at])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.append(same, False) | np.append(False, same)
    edges = np.zeros(len(words) + 1, np.int64)
    begins = order[twice] if len(order) > 1 else order[:0]
    edges[begins] += 1
    edges[begins + GRAM] -= 1
    return np.cumsum(edges[:-1]) > 0


def candidates(forward: Suffixes, part_ends: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, period): places of blocks and the distances at which they occur again."""
    n = len(left)
    tree = WaveletTree(forward.order)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    b = 2
    while b <= n:
        bounds = np.append(np.flatnonzero(forward.shared < b), n)
        at = np.arange(0, n, b)
        at = at[left[at] >= b]
        group = np.searchsorted(bounds, forward.rank[at], side="right") - 1
        low, high = bounds[group], bounds[group + 1]
        several = high - low > 1
        at, low, high = at[several], low[several], high[several]
        least, limit = at + 1, np.minimum(at + 4 * b - 2, part_ends[at] - b)
        first = True
        while len(at):
            place = tree.successor(low, high, least)
            kept = (place >= 0) & (place <= limit)
            at, low, high, limit, place = at[kept], low[kept], high[kept], limit[kept], place[kept]
            found.append((at, place - at))
            least = place + 1
            if first and len(at):
                near = place - at < b
                end = place + forward.common(at, place)
                least = np.where(near, end - b + 1, least)
            first = False
        if not (forward.shared >= b).any():
            break
        b *= 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def runs_of(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (first word, word after the last, period) of all runs, in this order; text numbers the texts of words, ascending."""
    at = np.flatnonzero(covered(words, text))
    if not len(at):
        return np.zeros((0, 3), np.int64)
    ends = np.append(np.flatnonzero((np.diff(at) > 1) | (np.diff(text[at]) > 0)) + 1, len(at))
    values, left, n = words[at].astype(np.int64), left_in_part(ends, len(at)), len(at)
    forward, backward = Suffixes(values, left), Suffixes(values[::-1], left_in_part(np.append(n - ends[:-1][::-1], n), n))
    p, q = candidates(forward, np.arange(n) + left, left)
    if not len(p):
        return np.zeros((0, 3), np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    inside = starts[np.searchsorted(ends, p, side="right")] < p
    behind = np.zeros(len(p), np.int64)
    behind[inside] = backward.common(n - p[inside], n - (p + q)[inside])
    first, last = p - behind, p + q + forward.common(p, p + q)
    long = last - first >= np.maximum(LEAST, 2 * q)
    first, last, q = first[long], last[long], q[long]
    order = np.lexsort((q, last, first))
    first, last, q = first[order], last[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    first, last, q = first[new], last[new], q[new]
    order = np.lexsort((q, first))
    return np.stack((at[first], at[last - 1] + 1, q), 1)[order]


def collapsed(words: list[bytes], runs: list[list[int]]) -> bytes:
    """The words without those that repeat the first period of a run."""
    kept, done = [], 0
    for a, b in sorted((first + q, last) for first, last, q in runs):
        kept += words[done : max(done, a)]
        done = max(done, b)
    return b" ".join(kept + words[done:]) if runs else b" ".join(words)


_RUN = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
_RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `runs` (start, length, period; by start, then period) and `collapsed`, the words that no run repeats, joined by blanks."""
    docs = docs.select(*[c for c in docs.columns if c not in ("runs", "collapsed")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, text, CHUNK_BYTES):
            if not table.num_rows:
                continue
            split = [(t or "").encode().split() for t in table.column(text).to_pylist()]
            sizes = np.array([len(w) for w in split], np.int64)
            numbers = Words()
            words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            starts = np.cumsum(sizes) - sizes
            of = np.repeat(np.arange(len(split)), sizes)
            found = runs_of(words, of)
            cuts = np.searchsorted(of[found[:, 0]], np.arange(len(split) + 1)).tolist()
            own = [(found[a:b] - [[s, s, 0]]).tolist() for a, b, s in zip(cuts, cuts[1:], starts.tolist(), strict=False)]
            told = pa.array([[{"start": a, "length": b - a, "period": q} for a, b, q in runs] for runs in own], _RUN)
            kept = pa.array([collapsed(ws, runs).decode() for ws, runs in zip(split, own, strict=True)], pa.string())
            yield from table.append_column("runs", told).append_column("collapsed", kept).to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("runs", _RUNS), T.StructField("collapsed", T.StringType())]))


def damaged(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of a row in ten, by the checksum of doc_id, the words from one on repeat with a period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def periodic(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")).otherwise("")

    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, bound(words, periodic)).otherwise(F.col("text")).alias("text"))


def digested(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256); the run is the longest, of these the first, of these the one of least period."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    told = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), longest.alias("run"), lines.alias("lines"))
    return told.select(
        "doc_id", "n_runs", F.col("run.start").alias("start"), (-F.col("run.length")).alias("length"), F.col("run.period").alias("period"),
        F.expr("1000 * -run.length div run.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digested(with_runs(damaged(docs)))
