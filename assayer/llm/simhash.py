"""Near-duplicates by SimHash, with tables of distances to reference fingerprints.

A fingerprint has 64 bits, each the majority of that bit in the XXH64 hashes of a text's
3-word shingles. Two fingerprints are linked at RADIUS or fewer differing bits; documents
are grouped by links between links.

By the triangle inequality, linked fingerprints differ by at most RADIUS in their distance
to any reference fingerprint (pivot). The distances to 16 pivots are tabulated once for
each fingerprint; pairs that differ by more in any coordinate are discarded, and the
survivors are verified on the fingerprints themselves. At radius 3 a coordinate lets about
half of unrelated pairs through, so the tables thin out pairs but cannot find them; the
pairs that are looked at share two of the five blocks of their bits, of which three
differing bits leave at least two untouched. No link is lost by either step.

Equal texts meet once, as one fingerprint. Within a group that shares blocks, only a
spanning forest of links leaves the task. A group of more than GROUP fingerprints is dealt
out as pairs of parts, so no task gets an unbounded group.

Defined cases: a null text is the empty text; texts without words have fingerprint zero and
are linked like any other; texts of one or two words have one shingle; equal rows get equal
results, one each; a null doc_id belongs to its text's group but is never its smallest; an
empty table gives no rows; columns of the input other than the two named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import settled

SHINGLE, SEED, RADIUS = 3, 42, 3
BLOCKS = (13, 13, 13, 13, 12)
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(16)], np.uint64)
#: A group that shares blocks is dealt out in parts of about so many fingerprints.
GROUP = 4096
#: So many hashes are turned into bits at a time.
BITS_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    k = min(SHINGLE, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text whose shingles have these hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[i : i + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :])


def forest(fps: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """Links between positions of fps that connect all that links connect."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order].astype(np.int16)
    left = np.arange(len(fps))
    links = []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            first = table[left, 0]
            near = left[np.searchsorted(first, table[x, 0] - RADIUS) : np.searchsorted(first, table[x, 0] + RADIUS, side="right")]
            for p in range(1, table.shape[1]):
                if not len(near):
                    break
                near = near[np.abs(table[near, p] - table[x, p]) <= RADIUS]
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= RADIUS]
            if len(near):
                links += [(int(order[x]), int(order[y])) for y in near]
                front += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of fingerprints to links (a, b)."""
    for batch in batches:
        groups = batch.column("fps")
        flat = groups.flatten().to_numpy().view(np.uint64)
        sizes = groups.value_lengths().to_numpy()
        table = pivot_table(flat)
        starts = np.cumsum(sizes) - sizes
        at = starts[sizes == 2]
        kept = np.abs(table[at].astype(np.int16) - table[at + 1]).max(1, initial=0) <= RADIUS
        at = at[kept]
        at = at[np.bitwise_count(flat[at] ^ flat[at + 1]) <= RADIUS]
        left, right = [flat[at]], [flat[at + 1]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found = np.array(forest(flat[start : start + size], table[start : start + size]), np.int64).reshape(-1, 2) + start
            left.append(flat[found[:, 0]])
            right.append(flat[found[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` that connect all that links connect."""
    edges = np.cumsum((0, *BLOCKS))
    mask = [((1 << int(e)) - 1) ^ ((1 << int(s)) - 1) for s, e in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    pairs = [mask[i] | mask[j] for i in range(len(mask)) for j in range(i)]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for i, m in enumerate(pairs)])
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key").repartition(n, "t", "key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    dealt = keyed.join(sizes, ["t", "key"]).withColumn("p", part).select("t", "key", "fp", F.col("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    dealt = dealt.select("t", "key", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "fp")
    groups = dealt.groupBy("t", "key", "p", "q").agg(F.collect_list("fp").alias("fps")).select("fps")
    return groups.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = settled(fingerprints(docs, key, text))
    kinds = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(kinds.select("fp")), "a", "b")
    rooted = kinds.join(roots, kinds["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
