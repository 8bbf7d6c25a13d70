"""Sharding by jump consistent hashing, with gapless row numbers in each shard.

The shard of a key follows from the key and the number of shards alone (Lamping and
Veach's jump consistent hash over the first 64 bits of the key's MD5); there is no
ring table, and one more shard takes rows only into itself.

Slots number the rows of a shard from 0 without one task per shard: rows fall into
4,096 sub-buckets of a shard by a digest, the bucket sizes are summed up first (a table
of at most shards x 4,096 rows), and rows are numbered inside their bucket only.

Defined cases: a null key counts as the empty string; a null text has 0 bytes and
checksum 0; rows that are equal in key, size and checksum are interchangeable and get
one slot each; texts count whole, however long; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The multiplier of the 64-bit linear congruential generator in the published algorithm.
LCG = 2862933555777941757
SHARDS = 40
#: Hex digits of the digest that name a sub-bucket: 16 ** 3 of them in each shard.
SUB_DIGITS = 3
#: Beyond so many sub-buckets in all, their offsets are joined by a shuffle, not broadcast.
BROADCAST_ROWS = 1_000_000
RECORD_BYTES = 16

_LOW = 0xFFFFFFFF


def _times_lcg(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) * LCG + 1 modulo 2^64 by 32-bit halves, so that no step overflows a long."""
    m_high, m_low = LCG >> 32, LCG & _LOW
    l0, l1 = low.bitwiseAND(0xFFFF), F.shiftright(low, 16)
    h0, h1 = high.bitwiseAND(0xFFFF), F.shiftright(high, 16)
    p0, p1 = l0 * F.lit(m_low), l1 * F.lit(m_low)
    low_sum = p0 + p1.bitwiseAND(0xFFFF) * F.lit(65536) + F.lit(1)
    carry = F.shiftright(low_sum, 32) + F.shiftright(p1, 16)
    cross = (h0 * F.lit(m_low) + (h1 * F.lit(m_low)).bitwiseAND(0xFFFF) * F.lit(65536)).bitwiseAND(_LOW)
    new_high = (cross + (low * F.lit(m_high)).bitwiseAND(_LOW) + carry).bitwiseAND(_LOW)
    return new_high, low_sum.bitwiseAND(_LOW)


def _walk(key: Column, shards: int) -> Column:
    """Struct with the last jump `b` below `shards` and the jump `j` after it."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    start = F.struct(half(1).alias("h"), half(9).alias("l"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        high, low = _times_lcg(s["h"], s["l"])
        # Two lambdas, so that the new key is worked out once and then used twice.
        moved = F.transform(F.array(F.struct(high.alias("h"), low.alias("l"))), lambda k: F.struct(
            k["h"].alias("h"), k["l"].alias("l"), s["j"].alias("b"),
            F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(k["h"], 1) + 1).cast("double"))).cast("long").alias("j"),
        ))[0]
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard 0..shards-1 of a key."""
    return _walk(key, shards)["b"].cast("int")


def jump_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """df with `shard`, and `grown_shard` for one shard more."""
    walked = F.transform(F.array(_walk(F.col(key), shards)), lambda s: F.struct(
        s["b"].cast("int").alias("shard"), F.when(s["j"] == F.lit(shards), F.lit(shards)).otherwise(s["b"].cast("int")).alias("grown_shard"),
    ))[0]
    return df.withColumn("_walk", walked).withColumn("shard", F.col("_walk.shard")).withColumn("grown_shard", F.col("_walk.grown_shard")).drop("_walk")


def numbered(df: DataFrame, shard: str, order: list[str], shards: int) -> DataFrame:
    """df with `slot`: rows of a shard numbered from 0 without gaps.

    Rows with equal `order` columns must be equal in all columns; they are counted
    before the shuffle and spread out again after it, so that a key with very many
    rows is one row on the way.
    """
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]).cast("binary"))
    kinds = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_sub", F.substring(digest, 1, SUB_DIGITS))
    sizes = kinds.groupBy(shard, "_sub").agg(F.sum("_copies").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = F.broadcast(offsets) if shards * 16**SUB_DIGITS <= BROADCAST_ROWS else offsets
    inside = Window.partitionBy(shard, "_sub").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(offsets, [shard, "_sub"])
    first = F.col("_offset") + F.col("_before")
    return placed.select(*df.columns, F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = numbered(jump_shards(rows, "doc_id", SHARDS), "shard", ["doc_id", "size", "text_crc32"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: DuckDB has no CRC-32: its byte table is built by the rule of the polynomial 0xEDB88320.
ORACLE_SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x
  FROM documents
), crcs AS (
  SELECT doc_id, n + {RECORD_BYTES} AS size, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(n), lambda i: ((instr('0123456789ABCDEF', x[2*i+1]) - 1) * 16 + instr('0123456789ABCDEF', x[2*i+2]) - 1)::UBIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INT + 1]))) AS text_crc32
  FROM texts, crc_table
), keyed AS (
  SELECT row_number() OVER () AS r, doc_id, size, text_crc32,
    md5(doc_id::VARCHAR) AS d, substr(md5(concat_ws(':', doc_id::VARCHAR, size::VARCHAR, text_crc32::VARCHAR)), 1, {SUB_DIGITS}) AS sub
  FROM crcs
), walk(r, k, b, j) AS (
  SELECT r, ('0x' || substr(d, 1, 16))::UBIGINT, 0::BIGINT, 0::BIGINT FROM keyed
  UNION ALL
  SELECT r, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, j, ((k::UHUGEINT * {LCG}::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS k2 FROM walk WHERE j < {SHARDS})
), jumps AS (SELECT r, max(b) AS b, max(j) AS j FROM walk GROUP BY r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, b::INT AS shard,
  (row_number() OVER (PARTITION BY b ORDER BY sub, doc_id, size, text_crc32) - 1)::BIGINT AS slot,
  CASE WHEN j = {SHARDS} THEN {SHARDS} ELSE b END::INT AS grown_shard
FROM keyed JOIN jumps USING (r)
"""
