"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features say whether a text has a character n-gram (3 to 5 characters of the lower-cased
text, hashed to 2^20 buckets). Each is scaled by the log ratio of its smoothed counts in
toxic and other texts; n-grams whose ratio is less than LEAST_SIGMA of its standard errors
from even are left out. Logistic regression is fitted on the scaled features, its weights
shrunk towards their mean, so that an n-gram that the sample has seldom still counts by its
ratio.

The classifier is fitted on at most SAMPLE labelled training rows, those with the
smallest hash of their id; counting is spread over tasks, and the fit sees just the chosen
n-grams of the sample. These stay with the executors: each step of the fit sends the weights
out and adds up the tasks' gradients, so the driver holds no row of the sample. Scoring sees
every row and its whole text, in the task that reads it, without a shuffle; the model (4 MB)
is sent to the executors.

Defined cases: a null text is the empty text and gets the score of the intercept alone;
if the sample has just one class, or no telling n-gram, every score is the smoothed share of
toxic rows in it, 0.5 if it has no rows; several labels of one id count as toxic if one of
them does; rows with a null label are not learnt from; of several texts of one id the least
is learnt from; equal rows get equal scores, one each; an empty table gives no rows; other
columns are carried along, but one with a result's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import chunks, held_out

FOLDS, HELD_OUT_FOLD = 5, 0
#: At most so many labelled rows are learnt from.
SAMPLE = 12_000
SHORTEST, LONGEST = 3, 5
BITS = 20
#: An n-gram is kept if its log-count ratio is so many of its standard errors from even.
LEAST_SIGMA = 3.0
#: Few steps, as more of them fit the sample alone.
STEPS, MEMORY, SHRINK, FIRST_WEIGHT, FIRST_STEP, LEAST_STEP = 15, 10, 1e-3, 0.05, 0.1, 1e-3
CHUNK_BYTES = 1_000_000
SAMPLE_TASKS = 12
#: So many rows of the sample are unpacked at a time.
ROWS_AT_ONCE = 128


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the buckets of all n-grams, and where each text begins and ends among them."""
    padded = [f" {(t or '').lower()} " for t in texts]
    sizes = np.array([len(p) for p in padded], np.int64)
    code = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = np.full(len(code), 2166136261, np.uint32)
    for n in range(1, min(LONGEST, len(code)) + 1):
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        if n >= SHORTEST:
            yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), starts, np.maximum(ends - n + 1, starts)


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram that a text has, once each; of the wanted buckets only, if they are given."""
    keys = []
    for buckets, starts, ends in grams(texts):
        at = np.arange(len(buckets)) if wanted is None else np.flatnonzero(wanted[buckets])
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at < ends[text]
        keys.append((text[inside] << BITS) | buckets[at[inside]].astype(np.int64))
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found >> BITS, found & ((1 << BITS) - 1)


def gradient(batch: pa.RecordBatch, scales: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The sums over rows (toxic, places) of the slope of each weight, of the intercept's, and of the loss."""
    out = np.zeros(len(weights) + 2)
    scaled = scales * weights
    for i in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(i, ROWS_AT_ONCE)
        per = [np.frombuffer(p.as_buffer(), np.int32) for p in part.column("places")]
        columns = np.concatenate(per)
        rows = np.repeat(np.arange(len(per)), [len(p) for p in per])
        z = np.bincount(rows, weights=scaled[columns], minlength=len(per)) + bias
        toxic = part.column("toxic").to_numpy()
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        out[:-2] += np.bincount(columns, weights=error[rows], minlength=len(weights))
        out[-2] += error.sum()
        out[-1] += (np.logaddexp(0, z) - toxic * z).sum()
    out[:-2] *= scales
    return out


def fit(picked: DataFrame, scales: np.ndarray, toxic: int, other: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression; each step is a job over the rows (toxic, places).

    Quasi-Newton steps (limited memory, MEMORY of them) with halving until the loss falls
    enough. The driver holds MEMORY vectors of the weights' length, at most 2^20.
    """
    n, context = toxic + other, picked.sparkSession.sparkContext
    shared = context.broadcast(scales)

    def loss_and_slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        now = context.broadcast(x)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.value) + 1)
            for batch in batches:
                total += gradient(batch, shared.value, now.value[:-1], float(now.value[-1]))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        parts = picked.mapInArrow(sums, "sums binary").toArrow()
        now.destroy()
        total = np.zeros(len(x) + 1)
        for one in parts.column("sums"):
            total += np.frombuffer(one.as_buffer(), float)
        total /= n
        apart = x[:-1] - x[:-1].mean()
        slope = total[:-1]
        slope[:-1] += SHRINK * apart
        return float(total[-1] + SHRINK / 2 * (apart @ apart)), slope

    x = np.append(np.full(len(scales), FIRST_WEIGHT), np.log(toxic / other))
    loss, slope = loss_and_slope(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step, kept = slope.copy(), []
        for s, y in reversed(moves):
            kept.append((s @ step) / (s @ y))
            step -= kept[-1] * y
        step *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else min(1.0, FIRST_STEP / max(np.abs(step).max(), 1e-12))
        for (s, y), k in zip(moves, reversed(kept), strict=True):
            step += s * (k - (y @ step) / (s @ y))
        size = 1.0
        while True:
            next_x = x - size * step
            next_loss, next_slope = loss_and_slope(next_x)
            if next_loss <= loss - 1e-4 * size * (slope @ step) or size < LEAST_STEP:
                break
            size /= 2
        s, y = next_x - x, next_slope - slope
        if s @ y > 1e-12:
            moves = [*moves, (s, y)][-MEMORY:]
        x, loss, slope = next_x, next_loss, next_slope
    shared.destroy()
    return x[:-1], float(x[-1])


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the rows to learn from."""
    marked = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = marked.join(docs.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The weight of each bucket (its ratio is in it) and the intercept."""
    sample = sampled(docs, labels).repartition(SAMPLE_TASKS).persist()
    try:
        totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, other = totals.get(1, 0), totals.get(0, 0)
        share = (toxic + 0.5) / (toxic + other + 1)
        by_share = np.zeros(1 << BITS), float(np.log(share / (1 - share)))
        if not toxic or not other:
            return by_share

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, 1 << BITS), np.int64)
            for table in chunks(batches, "text", CHUNK_BYTES):
                text, bucket = features(table.column("text").to_pylist())
                label = table.column("toxic").to_numpy()[text]
                for y in (0, 1):
                    sums[y] += np.bincount(bucket[label == y], minlength=1 << BITS)
            at = np.flatnonzero(sums.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "n0", "n1"])

        counts = sample.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
        sums = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("k")).first()
        ratio = F.log((F.col("n1") + 1) / F.lit(sums["n1"] + sums["k"])) - F.log((F.col("n0") + 1) / F.lit(sums["n0"] + sums["k"]))
        error = F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
        # At most 2^20 rows, by the number of buckets.
        chosen = counts.select("bucket", ratio.alias("r"), "n0", "n1").filter(F.abs("r") >= LEAST_SIGMA * error).orderBy("bucket").toArrow()
        counts.unpersist()
        if not len(chosen):
            return by_share
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen.column("bucket").to_numpy()] = np.arange(len(chosen))
        places = docs.sparkSession.sparkContext.broadcast(place)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = places.value >= 0
            for table in chunks(batches, "text", CHUNK_BYTES):
                text, bucket = features(table.column("text").to_pylist(), wanted)
                per = np.split(places.value[bucket], np.searchsorted(text, np.arange(1, table.num_rows)))
                yield pa.RecordBatch.from_arrays([table.column("toxic").combine_chunks(), pa.array([p.tobytes() for p in per], pa.binary())], ["toxic", "places"])

        picked = sample.sortWithinPartitions("doc_id").mapInArrow(pick, "toxic int, places binary").persist()
        try:
            weights, bias = fit(picked, chosen.column("r").to_numpy(), toxic, other)
        finally:
            picked.unpersist()
    finally:
        sample.unpersist()
    scaled = np.zeros(1 << BITS)
    scaled[chosen.column("bucket").to_numpy()] = weights * chosen.column("r").to_numpy()
    return scaled, bias


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `score` (0 to 1, higher: toxic is likelier) and `predicted`."""
    weights, bias = trained(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), weights != 0))
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, wanted = model.value
        for table in chunks(batches, "text", CHUNK_BYTES):
            text, bucket = features(table.column("text").to_pylist(), wanted)
            z = np.bincount(text, weights=weight[bucket], minlength=table.num_rows) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield from table.append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= 0.5).astype(np.int32))).to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return scored(docs, labels).select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD).alias("held_out"), "score", "predicted")
