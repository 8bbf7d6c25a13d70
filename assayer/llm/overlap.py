"""Documents grouped by the overlap of their sets of 5-word shingles.

Two texts are linked if the Jaccard similarity of their shingle sets is LEAST or more;
documents are grouped by links between links. Every link is confirmed on the whole sets;
SimHash with its pivot tables and sketches only propose pairs.

Pairs come in two rounds. The first is linear: SimHash links of the 5-word shingles, and
in each group that shares a band of the min-hash sketch, the pairs with the group's least
member. The second looks at the groups whose members are still in several components: those
outside of a group's most frequent component meet the others, in parts of GROUP members and
PART_BYTES of sets. Members with a like sketch in another component meet once more, with
their sets, and there pairs are compared best first until a link is found. What leaves a
task is a forest of links, so a large group of near copies costs what its stray members
cost. A pair at similarity 0.8 shares none of BANDS bands of ROWS minima with a chance of 3
in a million, and less above.

Equal shingle sets meet once, as one node. Only nodes of pairs whose sketches are alike and
of groups that stay open get the sets of their shingles; a text is hashed again for that,
so sets are never held for all texts. Copies of a text are the same text to that: each task
sends it once, however many rows have it. Texts are told apart by 64 bits and their length.

Defined cases: a null text is the empty text; texts without words are linked to each
other; texts of fewer than five words have one shingle; texts are hashed whole, however
long; repeated rows get a row each, with one component; of equally good links any one is
kept, as components do not depend on it; a null doc_id belongs to its text's group but is
never its smallest; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .graph import components
from .shared import chunks, settled

SHINGLE, SEED = 5, 42
#: 4 of 5: whole numbers, so that pairs at just 0.8 are linked.
LEAST = (4, 5)
#: A band is ROWS minima of 16 bits, one whole number.
BANDS, ROWS = 24, 4
#: Pairs whose sketches agree in fewer places are not looked at: five standard errors below 0.8.
LIKELY = 57
GROUP, PART_BYTES = 1024, 16_000_000
CHUNK_BYTES = 1_000_000
_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_B = [f"b{i}" for i in range(BANDS)]
_KEY = "struct<hash: long, size: int>"


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's shingles, in order; of the empty shingle where there are no words."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist() or [0]
    k = max(1, min(SHINGLE, len(words)))
    starts = [0, *(e + 1 for e in ends[: len(ends) - k])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)], np.uint64)


def sketches(hashes: list[np.ndarray]) -> np.ndarray:
    """The least of each of BANDS * ROWS rehashes of every text's shingles, ROWS of them in one whole number."""
    flat = np.concatenate(hashes)
    starts = np.cumsum([0, *map(len, hashes[:-1])])
    out = np.empty((len(hashes), BANDS * ROWS), np.uint16)
    for i, (factor, shift) in enumerate(zip(FACTORS, SHIFTS, strict=True)):
        # The least by all 64 bits; its lower bits are as good as random.
        least = np.minimum.reduceat(flat * factor + shift, starts)
        out[:, i] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out.view(np.int64)


def kind_of(shingle_set: np.ndarray) -> str:
    """One name for all texts with the same sorted set of shingles."""
    return xxhash.xxh128_hexdigest(shingle_set.tobytes(), SEED)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches, "text", CHUNK_BYTES):
        if not table.num_rows:
            continue
        hashes = [shingles(t.as_py()) for t in table.column("text")]
        fps = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
        sketch = sketches(hashes)
        sets = [np.unique(h) for h in hashes]
        columns = [pa.array([kind_of(h) for h in sets]), pa.array([len(h) for h in sets], pa.int64()), pa.array(fps), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(BANDS))]
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("doc_id", "text_key")), *columns], ["doc_id", "text_key", "kind", "size", "fp", *_B])


def _once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text_key, text) without those whose text the task has had."""
    seen: set[tuple] = set()
    for batch in batches:
        keys = batch.column("text_key")
        fresh = []
        for key in zip(keys.field(0).to_pylist(), keys.field(1).to_pylist(), strict=True):
            fresh.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches, "text", CHUNK_BYTES):
        hashes = [np.unique(shingles(t.as_py())) for t in table.column("text")]
        yield pa.RecordBatch.from_arrays([table.column("node").combine_chunks(), pa.array([h.tobytes() for h in hashes], pa.binary())], ["node", "set"])


def overlapping(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of LEAST or more."""
    part, whole = LEAST
    if min(len(a), len(b)) * whole < part * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * whole >= part * (len(a) + len(b) - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("set_a"), batch.column("set_b")
        kept = [overlapping(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(left, right, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _places(column: pa.Array) -> np.ndarray:
    """Arrays of bands as rows of minima."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS).view(np.uint16)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alike = (_places(batch.column("sketch_a")) == _places(batch.column("sketch_b"))).sum(1) >= LIKELY
        yield batch.select(["a", "b"]).filter(pa.array(alike))


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups to their members (key, node) that have a like sketch in another component."""
    for batch in batches:
        for key, members in zip(batch.column("key"), batch.column("members"), strict=True):
            group = members.values
            node, root = (group.field(c).to_numpy(zero_copy_only=False) for c in ("node", "root"))
            minor = group.field("minor").to_numpy(zero_copy_only=False)
            sketch = _places(group.field("sketch"))
            marked = np.zeros(len(node), bool)
            majors, minors = np.flatnonzero(~minor), np.flatnonzero(minor)
            for k, i in enumerate(minors.tolist()):
                others = majors if len(majors) else minors[k + 1 :]
                alike = ((sketch[others] == sketch[i]).sum(1) >= LIKELY) & (root[others] != root[i])
                marked[others[alike]] = True
                marked[i] |= bool(alike.any())
            found = node[marked]
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], ["key", "node"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups to confirmed links (a, b) that connect all components which pairs of their members connect.

    Members outside of the group's major component meet those in it, or, in a group
    without such, each other.
    """
    for batch in batches:
        for members in batch.column("members"):
            group = members.values
            node, root = (group.field(c).to_numpy(zero_copy_only=False) for c in ("node", "root"))
            minor = group.field("minor").to_numpy(zero_copy_only=False)
            sketch, sets = _places(group.field("sketch")), group.field("set")
            whole = lambda i, sets=sets: np.frombuffer(sets[i].as_buffer(), np.uint64)
            joined: dict[int, int] = {}

            def find(r: int, joined=joined) -> int:
                while r in joined:
                    r = joined[r]
                return r

            links = []
            majors = np.flatnonzero(~minor)
            minors = np.flatnonzero(minor)
            for k, i in enumerate(minors.tolist()):
                others = majors if len(majors) else minors[k + 1 :]
                alike = (sketch[others] == sketch[i]).sum(1)
                order = np.argsort(-alike, kind="stable")
                for j in others[order[: int((alike >= LIKELY).sum())]].tolist():
                    a, b = find(int(root[i])), find(int(root[j]))
                    if a != b and overlapping(whole(i), whole(j)):
                        joined[a] = b
                        links.append(sorted((int(node[i]), int(node[j]))))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links]), pa.array([y for _, y in links])], ["a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), F.struct(F.xxhash64(docs[text]).alias("hash"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).alias("size")).alias("text_key"))
    kind = docs.schema[key].dataType.simpleString()
    prints = settled(rows.mapInArrow(_sketched, f"doc_id {kind}, text_key {_KEY}, kind string, size long, fp long, {', '.join(f'{b} long' for b in _B)}"))
    # One node for each set of shingles; numbered once its rows are written, so that the numbers stay.
    kinds = settled(prints.groupBy("kind").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.first("fp").alias("fp"), F.first("size").alias("size"), *[F.first(b).alias(b) for b in _B])).withColumn("node", F.monotonically_increasing_id())
    sketched = kinds.select("node", F.array(*_B).alias("sketch"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, set); texts that share a key are equal, so one of them stands for its node."""
        wanted = kinds.join(nodes, "node", "left_semi").select("node", "text_key")
        once = rows.select("text_key", "text").mapInArrow(_once_a_task, f"text_key {_KEY}, text string")
        texts = once.join(wanted, "text_key").select("node", "text").mapInArrow(_sets, "node long, set binary")
        return settled(texts.groupBy("node").agg(F.first("set").alias("set")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = settled(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
        side = lambda df, s, what: df.select(F.col("node").alias(s), F.col(what).alias(f"{what}_{s}"))
        pairs = settled(pairs.join(side(sketched, "a", "sketch"), "a").join(side(sketched, "b", "sketch"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(_likely, "a long, b long"))
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        return settled(pairs.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirmed, "a long, b long"))

    def rooted(links: DataFrame) -> DataFrame:
        roots = components(links, "a", "b").withColumnRenamed("node", "_node")
        return kinds.select("node", "kind", "least").join(roots, F.col("node") == F.col("_node"), "left").select("node", "kind", "least", F.coalesce("root", "node").alias("root"))

    keyed = kinds.select("node", F.posexplode(F.array(*_B)).alias("t", "band")).select("node", F.xxhash64("t", "band").alias("key")).repartition(n, "key")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    shared = settled(keyed.join(sizes.select("key", "first"), "key"))

    heads = kinds.groupBy("fp").agg(F.min("node").alias("head"))
    head = lambda s: heads.select(F.col("fp").alias(s), F.col("head").alias(f"head_{s}"))
    pairs = shared.select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = pairs.union(kinds.join(heads, "fp").select("head", "node"))
    pairs = pairs.union(simhash.links(kinds.select("fp").distinct()).join(head("a"), "a").join(head("b"), "b").select("head_a", "head_b"))
    links = confirmed(pairs)

    members = shared.select("key", "node").join(rooted(links).select("node", "root"), "node")
    by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    still_open = by_root.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root"))["root"].alias("major")).filter("roots > 1").select("key", "major")
    sided = settled(members.join(still_open, "key").join(kinds.select("node", "size"), "node").withColumn("minor", F.col("root") != F.col("major")))

    def groups(rows: DataFrame, *tables: DataFrame) -> DataFrame:
        """(key, members): rows (key, node, root, minor, size) of a group that meet in a task, with what the tables have for their nodes."""
        share = lambda side: F.greatest(F.ceil(F.count_if(side) / GROUP), F.ceil(F.sum(F.when(side, F.col("size") * 8)) / PART_BYTES)).cast("int")
        parts = rows.groupBy("key").agg(share(~F.col("minor")).alias("majors"), share(F.col("minor")).alias("minors"))
        own = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors")).cast("long")).cast("int")
        every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        task = lambda kind, p, q: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"))
        mine = F.col("own")
        minor_tasks = F.concat(F.transform(every("majors"), lambda p: task("across", p, mine)), F.transform(every("minors"), lambda q: task("among", F.least(q, mine), F.greatest(q, mine))))
        tasks = F.when(F.col("minor"), minor_tasks).otherwise(F.transform(every("minors"), lambda q: task("across", mine, q)))
        dealt = rows.join(parts, "key").withColumn("own", own).select("key", "node", "root", "minor", F.explode(tasks).alias("task"))
        for table in tables:
            dealt = dealt.join(table, "node")
        return dealt.groupBy("key", "task").agg(F.collect_list(F.struct(*[c for c in dealt.columns if c not in ("key", "task")])).alias("members")).select("key", "members")

    hopeful = settled(groups(sided, sketched).mapInArrow(_hopeful, "key long, node long").distinct())
    sets = sets_of(hopeful.select("node").distinct())
    more = settled(groups(settled(sided.join(hopeful, ["key", "node"])), sketched, sets).mapInArrow(_across, "a long, b long"))

    grouped = settled(rooted(links.union(more)).select("kind", "least", "root"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("kind", "component_id")
    return prints.select("doc_id", "kind").join(named, "kind").select("doc_id", "component_id")
