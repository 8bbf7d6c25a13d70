import zlib
from collections import Counter
from hashlib import md5

import pytest

from assayer.llm import sharding


def jump(key, n):
    """The published loop, over Python's own integers."""
    k = int(md5(key.encode()).hexdigest()[:16], 16)
    b, j = -1, 0
    while j < n:
        b = j
        k = (k * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_same_as_published_loop(spark, n):
    rows = sharding.jump_shards(spark.range(2000), "id", n).collect()
    assert all(r.shard == jump(str(r.id), n) and r.grown_shard == jump(str(r.id), n + 1) for r in rows)
    assert all(r.grown_shard in (r.shard, n) for r in rows)


def test_slots_are_gapless_with_ties_nulls_and_repeated_rows(spark):
    data = [(i % 50, 3, 4) for i in range(500)] + [(None, 1, 1)] * 3 + [(7, 9, 9)]
    df = spark.createDataFrame(data, "doc_id long, size long, text_crc32 long")
    rows = sharding.numbered(sharding.jump_shards(df, "doc_id", 5), "shard", ["doc_id", "size", "text_crc32"], 5).collect()
    assert len(rows) == len(data)
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def test_empty(spark):
    assert sharding.numbered(sharding.jump_shards(spark.range(0), "id", 4), "shard", ["id"], 4).count() == 0


def test_query_on_odd_documents(spark, tmp_path):
    data = [(1, None, "a"), (2, "", "b"), (3, "é" * 100000, "c"), (3, "é" * 100000, "c"), (None, "x", None)]
    spark.createDataFrame(data, "doc_id long, text string, shard string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.query(spark, str(tmp_path)).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in data)
