"""Ids of documents that are too large for a row: hashes that run over sorted pieces.

A document is laid out as pieces (keys, section, name, part, text), which in the order of
section, name and part are its canonical text: literal heads and tails, and the entries of
its maps and lists, between which commas are put. All pieces of a document meet in one task,
as its id is one hash from its first byte to its last, but they stream through it: a task
holds no more than a batch, whatever the number of entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.identity import canonical_text, json_array, json_string

#: (keys, section, name, part, text); a name sorts as its bytes do, which is how canonical texts sort keys.
ORDER = ["section", "name", "part"]


def literal(headers: DataFrame, keys: list[str], section: int, text: Column) -> DataFrame:
    """A piece for each document."""
    return headers.select(*keys, F.lit(section).alias("section"), F.lit("").alias("name"), F.lit("").alias("part"), text.alias("text"))


def entries(rows: DataFrame, keys: list[str], section: int, name: Column, text: Column) -> DataFrame:
    """A piece for each row, in the order of the names."""
    return rows.select(*keys, F.lit(section).alias("section"), name.alias("name"), F.lit("").alias("part"), text.alias("text"))


def pair(name: Column, value: Column) -> Column:
    return F.concat(json_string(name), F.lit(":"), json_string(value))


def hashed(pieces: list[DataFrame], keys: list[str], kind: str) -> DataFrame:
    """(keys, id, n_bytes) of each document.

    A comma goes before a piece unless it comes first in a map or list or begins with a
    closing bracket or a comma of its own.
    """
    every = pieces[0]
    for more in pieces[1:]:
        every = every.unionByName(more)
    fields = [every.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [batch.schema.field(k).type for k in keys]
                yield from zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column("text").to_pylist(), strict=True)

        for key, found in groupby(rows(), key=lambda r: r[0]):
            digest, size, last = hashlib.sha256(), 0, "{"
            for _, text in found:
                if last not in "{[" and text[:1] not in "}],":
                    text = "," + text
                raw = text.encode()
                digest.update(raw)
                size += len(raw)
                last = text[-1:] or last
            yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, types, strict=True)), pa.array([f"{kind}-{digest.hexdigest()}"]), pa.array([size], pa.int64())], [*keys, "id", "n_bytes"])

    dealt = every.select(*keys, *ORDER, "text").repartition(*keys).sortWithinPartitions(*keys, *ORDER)
    return dealt.mapInArrow(run, T.StructType([*fields, T.StructField("id", T.StringType()), T.StructField("n_bytes", T.LongType())]))


def snapshot_ids(headers: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, n_bytes) of snapshots.

    headers are (keys, snapshot_version, exclusions, binary_paths, base_revision,
    visible_config): lists are sets, so they are sorted; visible_config is open JSON, none
    counts as an empty object. files are (keys, path, hash, mode); a header without files is
    a snapshot of none, files without a header are left out.
    """
    quoted = lambda c: F.coalesce(json_string(F.col(c)), F.lit("null"))
    sorted_set = lambda c: json_array(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))))
    head = F.concat(F.lit('{"base_revision":'), quoted("base_revision"), F.lit(',"binary_paths":'), sorted_set("binary_paths"), F.lit(',"exclusions":'), sorted_set("exclusions"), F.lit(',"file_modes":{'))
    tail = F.concat(F.lit('},"snapshot_version":'), quoted("snapshot_version"), F.lit(',"visible_config":'), F.coalesce(canonical_text(F.col("visible_config")), F.lit("{}")), F.lit("}"))
    own = files.join(headers.select(*keys).distinct(), keys, "left_semi")
    return hashed(
        [
            literal(headers, keys, 0, head),
            entries(own, keys, 1, F.col("path"), pair(F.col("path"), F.col("mode"))),
            literal(headers, keys, 2, F.lit('},"files":{')),
            entries(own, keys, 3, F.col("path"), pair(F.col("path"), F.col("hash"))),
            literal(headers, keys, 4, tail),
        ],
        keys, "snap",
    )


def bundle_ids(headers: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, n_bytes) of bundles: headers (keys, bundle_version, env_id), members (keys, path, hash, mode) in the order of their paths."""
    head = F.concat(F.lit('{"bundle_version":'), json_string(F.col("bundle_version")), F.lit(',"env_id":'), json_string(F.col("env_id")), F.lit(',"members":['))
    member = F.concat(F.lit('{"mode":'), json_string(F.col("mode")), F.lit(',"path":'), json_string(F.col("path")), F.lit(',"sha256":'), json_string(F.col("hash")), F.lit("}"))
    own = members.join(headers.select(*keys).distinct(), keys, "left_semi")
    return hashed([literal(headers, keys, 0, head), entries(own, keys, 1, F.col("path"), member), literal(headers, keys, 2, F.lit("]}"))], keys, "bundle")


def environment_ids(headers: DataFrame, rewards: DataFrame, tasks: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, n_bytes) of environments.

    headers are (keys, environment_version, substrate_profile, subject, profiles), the last
    two open JSON; rewards (keys, path, reward_id) and tasks (keys, path, task_id) are
    sets in the order of their ids; members (keys, split, task_id) are sets of tasks, so
    a task counts once; a split without members is one row with a null task_id.
    """
    open_json = lambda c: F.coalesce(canonical_text(F.col(c)), F.lit("{}"))
    listed = lambda kind: F.concat(F.lit('{"path":'), json_string(F.col("path")), F.lit(f',"{kind}":'), json_string(F.col(kind)), F.lit("}"))
    member = members.select(*keys, "split", "task_id").distinct()
    split = lambda part, text, rows: rows.select(*keys, F.lit(3).alias("section"), F.col("split").alias("name"), part.alias("part"), text.alias("text"))
    splits = member.select(*keys, "split").distinct()
    head = F.concat(F.lit('{"environment_version":'), json_string(F.col("environment_version")), F.lit(',"profiles":'), open_json("profiles"), F.lit(',"rewards":['))
    middle = F.concat(F.lit('},"subject":'), open_json("subject"), F.lit(',"substrate_profile":'), json_string(F.col("substrate_profile")), F.lit(',"tasks":['))
    return hashed(
        [
            literal(headers, keys, 0, head),
            entries(rewards, keys, 1, F.col("reward_id"), listed("reward_id")),
            literal(headers, keys, 2, F.lit('],"splits":{')),
            # A split's members lie between its head and its tail.
            split(F.lit("0"), F.concat(json_string(F.col("split")), F.lit(":[")), splits),
            split(F.concat(F.lit("1"), F.col("task_id")), json_string(F.col("task_id")), member.filter("task_id is not null")),
            split(F.lit("2"), F.lit("]"), splits),
            literal(headers, keys, 4, middle),
            entries(tasks, keys, 5, F.col("task_id"), listed("task_id")),
            literal(headers, keys, 6, F.lit("]}")),
        ],
        keys, "env",
    )


def map_digests(rows: DataFrame, keys: list[str], path: str, value: str) -> DataFrame:
    """(keys, digest) of the canonical map path -> value; the digest of an empty map where there are no paths."""
    sets = rows.select(*keys).distinct()
    some = rows.filter(F.col(path).isNotNull())
    found = hashed([literal(sets, keys, 0, F.lit("{")), entries(some, keys, 1, F.col(path), pair(F.col(path), F.col(value))), literal(sets, keys, 2, F.lit("}"))], keys, "sha256")
    return found.select(*keys, F.concat(F.lit("sha256:"), F.substring("id", 8, 64)).alias("digest"))
