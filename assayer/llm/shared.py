"""What several operators of this folder use."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: the ASCII blank, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, other letters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for a null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the cluster shares, and read back from there.

    The folder comes from the session (spark.checkpoint.dir). Where that is unset, a folder
    under the warehouse serves a session on one machine, as in tests; a cluster is refused.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        sc.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row belongs to the fold that is kept from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Batches put together or cut so that each has about `most` bytes in a column of texts."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first = 0
        for i, n in enumerate(sizes.tolist()):
            size += n
            if size >= most:
                yield pa.Table.from_batches([*held, batch.slice(first, i + 1 - first)])
                held, size, first = [], 0, i + 1
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


#: Beyond so many keys, rows to leave out are found by a shuffle, not a broadcast.
BROADCAST_KEYS = 2_000_000


def without(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is in keys; rows with a null key stay."""
    keys = settled(keys.select(key).distinct())
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_anti")
