"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame operations only.

A document is compared with a benchmark item of n words through its windows of n words.
Similarity is exact and weighted: the multisets of 5-word shingles of window and item,
smaller counts over larger counts; SIMILAR or more is a match. A text with fewer than 5
words is one shingle.

1. Windows. A match lacks at most a fifth of its item's shingles, so of any
   fifth of them and one more it has one: of an item's shingles those that are rarest in the
   documents (then in the benchmark) decide which documents are looked at. In these, windows
   are laid wherever a shingle is one of the item's, the two aligned. A lead-in that many
   items or documents share thus brings no pairs about.
2. SimHash of each window and each item over their shingles, 64 bits.
3. Multi-index Hamming blocks: the bits are cut into 11 blocks; of RADIUS = 21 differing
   bits some block holds at most one, so an item is looked up in each block under its own
   value and under those at one bit's distance. All fingerprints within the radius meet.
   Blocks this narrow tell nothing from nothing, so a window is looked up only among the
   items that it was laid for; those are the ones that it can match best.
   A similarity of 0.8 means some 10 differing bits; 21 is four standard deviations more.
4. The survivors are verified on the shingles.

The benchmark's shingles and the found windows are broadcast while they are few
(BROADCAST_ROWS) and joined by a shuffle beyond that; documents are read twice and their
texts are not shuffled in the first case. Places of the benchmark's shingles in documents
are written down once; their number grows with the documents, not with items that share them.

Defined cases: null texts are empty; texts and items are compared whole, however long;
items without words match nothing; a window cut off
by an end of the document is as long as it gets; equal documents are judged alike and are
reported as one row for a document id and an item, with the best window (the first one of
equals); a null doc_id is an id like others; empty tables give no rows; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bound, settled, words_of

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 21
BLOCKS = (6, 6, 6, 6, 6, 6, 6, 6, 6, 5, 5)
#: A document's windows are taken up to so many starts at a time.
STARTS = 256
#: Beyond so many rows a table is joined by a shuffle, not broadcast.
BROADCAST_ROWS = 1_000_000


def _hashes(words: Column, first: Column, last: Column, length: int = SHINGLE) -> Column:
    """Hashes of the shingles of `length` words within words[first..last], 0-based; of what there is, if that is less."""
    at = lambda i: F.xxhash64(*[F.when(i + k <= last, F.get(words, (i + k).cast("int"))) for k in range(length)])
    return F.when(last < first, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(first, F.greatest(last - (length - 1), first)), at))


def _numbered(hashes: Column, length: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(F.lit(length).alias("length"), i.alias("at"), h.alias("h")))


def simhash(hashes: Column) -> Column:
    """64 bits, each set if it is in over half of the hashes."""
    ones = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + _bit(h, b).cast("int")))
    return bound(F.struct(ones.alias("n"), F.size(hashes).alias("of")), lambda s: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda fp, b: fp.bitwiseOR(F.when(F.get(s["n"], b) * 2 > s["of"], _shift(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))))


def _bit(value: Column, at: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, at).bitwiseAND(F.lit(1).cast("long"))


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _blocks(fp: Column, probes: bool) -> Column:
    """Array of (block, value); with probes, also of all values at one bit's distance."""
    found, start = [], 0
    for i, width in enumerate(BLOCKS):
        value = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for flip in [0, *(1 << b for b in range(width))] if probes else [0]:
            found.append(F.struct(F.lit(i).alias("block"), value.bitwiseXOR(F.lit(flip).cast("long")).alias("value")))
        start += width
    return F.array(*found)


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if it has few rows; `rows` where its rows hold arrays, as the entries of these."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, hashes, fp), one row an item with words."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    hashed = words.select("item_id", "n", bound(F.col("w"), lambda w: _hashes(w, F.lit(0), F.size(w) - 1)).alias("hashes"))
    return hashed.withColumn("fp", simhash(F.col("hashes")))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, distance): the best window for each document and item that match."""
    items = settled(items_of(benchmark).withColumn("item", F.xxhash64("item_id", "hashes")).dropDuplicates(["item"]))
    places = settled(items.select("item", "n", F.size("hashes").alias("size"), F.posexplode("hashes").alias("item_at", "h"), F.least("n", F.lit(SHINGLE)).alias("length")))
    lengths = sorted(r[0] for r in items.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())
    rows = docs.select("doc_id", F.col("text"), F.xxhash64("doc_id", "text").alias("row"))
    # 1. windows
    seen = bound(words_of(F.col("text")), lambda w: F.flatten(F.array(*[_numbered(_hashes(w, F.lit(0), F.size(w) - 1, k), k) for k in lengths])))
    if not lengths:
        seen = F.array().cast("array<struct<length:int,at:int,h:long>>")
    seen = settled(rows.select("row", F.explode(seen).alias("s")).select("row", "s.*").join(_small(places.select("h", "length").distinct()), ["h", "length"], "left_semi"))
    often = seen.groupBy("h", "length").agg(F.count(F.lit(1)).alias("in_docs"))
    counted = places.join(often, ["h", "length"], "left").join(places.groupBy("h", "length").agg(F.count(F.lit(1)).alias("in_items")), ["h", "length"])
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("in_docs", F.lit(0)), "in_items", "h", "item_at"))
    enough = F.floor((1 - SIMILAR) * F.col("size") + 1e-9) + 1
    rarest = counted.withColumn("rank", rank).filter(F.col("rank") <= enough).select("item", "h", "length").distinct()
    pairs = settled(seen.join(_small(rarest), ["h", "length"]).select("row", "item").distinct())
    laid = seen.join(_small(pairs), "row").join(_small(places), ["item", "h", "length"])
    windows = settled(laid.select("row", (F.col("at") - F.col("item_at")).alias("start"), "n", "item").distinct())
    # 2. their shingles and fingerprints
    grouped = windows.select("row", "start", "n").distinct().groupBy("row", F.expr(f"start div {STARTS}").alias("part")).agg(F.collect_list(F.struct("start", "n")).alias("windows")).drop("part")
    n_windows = windows.count()
    placed = rows.join(_small(grouped, n_windows), "row").select("doc_id", "row", "windows", words_of(F.col("text")).alias("w"))
    cut = lambda w, x: _hashes(w, F.greatest(x["start"], F.lit(0)), F.least(x["start"] + x["n"], F.size(w)) - 1)
    each = bound(F.col("w"), lambda w: F.transform("windows", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), cut(w, x).alias("hashes"))))
    printed = settled(placed.select("doc_id", "row", F.explode(each).alias("x")).select("doc_id", "row", "x.*").withColumn("fp", simhash(F.col("hashes"))).distinct())
    # 3. within the radius
    probes = items.select("item", "item_id", "n", F.col("fp").alias("item_fp"), F.size("hashes").alias("item_size"), F.explode(_blocks(F.col("fp"), True)).alias("b")).select("item", "item_id", "n", "item_fp", "item_size", "b.*")
    own = printed.select("doc_id", "row", "start", "n", "fp").join(_small(windows, n_windows), ["row", "start", "n"])
    spots = own.select("doc_id", "row", "start", "n", "item", "fp", F.explode(_blocks(F.col("fp"), False)).alias("b")).select("doc_id", "row", "start", "n", "item", "fp", "b.*")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = spots.join(_small(probes), ["item", "n", "block", "value"]).filter(distance <= RADIUS)
    near = near.select("doc_id", "row", "start", "n", "item", "item_id", "item_size", distance.alias("distance")).distinct()
    # 4. verified
    counts = _small(items.select("item", F.explode("hashes").alias("h")).groupBy("item", "h").agg(F.count(F.lit(1)).alias("c")))
    counted = printed.select("row", "start", "n", "hashes").distinct().join(near, ["row", "start", "n"])
    shingles = counted.select(F.struct("doc_id", "row", "start", "n", "item", "item_id", "item_size", "distance", F.size("hashes").alias("size")).alias("pair"), F.explode("hashes").alias("h"))
    shared = shingles.groupBy("pair", "h").agg(F.count(F.lit(1)).alias("k")).select("pair", F.col("pair.item").alias("item"), "h", "k").join(counts, ["item", "h"])
    shared = shared.groupBy("pair").agg(F.sum(F.least("k", "c")).alias("both")).select("pair.*", "both")
    scored = shared.withColumn("similarity", F.col("both").cast("double") / (F.col("size") + F.col("item_size") - F.col("both")).cast("double")).filter(F.col("similarity") >= SIMILAR)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.greatest("start", F.lit(0)).alias("start"), "size", "distance", "n"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start", F.col("b.n").alias("n_words"), (-F.col("b.s")).alias("similarity"), "b.distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).drop("distance")


def _words_sql(table: str, key: str) -> str:
    return f"""SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}"""


#: All windows that share a shingle with an item, compared in full; no fingerprints.
ORACLE_SQL = f"""
WITH d AS ({_words_sql("documents", "doc_id")}), i AS (SELECT * FROM ({_words_sql("benchmark", "item_id")}) WHERE len(w) > 0),
di AS (SELECT item_id, len(w) AS n, greatest(len(w) - {SHINGLE - 1}, 1) AS size, unnest(range(greatest(len(w) - {SHINGLE - 1}, 1))) AS pos, w FROM i),
ig AS (SELECT item_id, n, size, pos, array_to_string(w[pos + 1 : pos + {SHINGLE}], ' ') AS g, least(n, {SHINGLE}) AS k FROM di),
ks AS (SELECT DISTINCT k FROM ig),
dp AS (SELECT doc_id, k, w, unnest(range(greatest(len(w) - k + 1, 0))) AS pos FROM d, ks),
dg AS (SELECT doc_id, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS g FROM dp),
win AS (SELECT DISTINCT doc_id, item_id, dg.pos - ig.pos AS start, n, size AS item_size FROM dg JOIN ig USING (g, k)),
cut AS (SELECT doc_id, item_id, start, n, item_size, w[greatest(start, 0) + 1 : least(start + n, len(w))] AS w FROM win JOIN d USING (doc_id)),
wp AS (SELECT * EXCLUDE w, greatest(len(w) - {SHINGLE - 1}, 1) AS size, w, unnest(range(greatest(len(w) - {SHINGLE - 1}, 1))) AS pos FROM cut),
wg AS (SELECT doc_id, item_id, start, n, item_size, size, array_to_string(w[pos + 1 : pos + {SHINGLE}], ' ') AS g, count(*) AS c FROM wp GROUP BY ALL),
ic AS (SELECT item_id, g, count(*) AS c FROM ig GROUP BY ALL),
common AS (SELECT doc_id, item_id, start, n, item_size, size, sum(least(wg.c, ic.c)) AS b FROM wg JOIN ic USING (item_id, g) GROUP BY ALL),
s AS (SELECT doc_id, item_id, start, n, b::DOUBLE / (size + item_size - b)::DOUBLE AS similarity FROM common)
SELECT doc_id, item_id, greatest(start, 0)::INT AS start, n::INT AS n_words, similarity FROM s WHERE similarity >= {SIMILAR}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, greatest(start, 0)) = 1
"""
