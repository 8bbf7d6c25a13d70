"""Toxicity: no n-gram is left out for a moderate ratio."""

import numpy as np

from assayer.llm import toxicity


def test_widespread_ngram_of_moderate_ratio_counts(spark):
    # Nine in ten toxic and nine in twenty other texts have the word: a log ratio of about 0.7.
    rows = [(i, "text zug" if i % 20 < (18 if i < 400 else 9) else "text") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(800)], "doc_id long, toxic int")
    scores = {r.text: r.score for r in toxicity.scored(docs, labels).collect()}
    assert scores["text zug"] > 0.5 > scores["text"]


def test_gradient_equals_definition():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    has = rng.random((300, 20)) < 0.3
    toxic, scales, weights = rng.integers(0, 2, 300), rng.standard_normal(20), rng.standard_normal(20)
    batch = pa.RecordBatch.from_arrays([pa.array(toxic.astype(np.int32)), pa.array([np.flatnonzero(r).astype(np.int32).tobytes() for r in has], pa.binary())], ["toxic", "places"])
    error = 1 / (1 + np.exp(-((has * scales) @ weights + 0.3))) - toxic
    z = (has * scales) @ weights + 0.3
    loss = -(toxic * np.log(1 / (1 + np.exp(-z))) + (1 - toxic) * np.log(1 / (1 + np.exp(z)))).sum()
    got = toxicity.gradient(batch, scales, weights, 0.3)
    assert np.allclose(got[:-2], (has * scales).T @ error) and np.isclose(got[-2], error.sum()) and np.isclose(got[-1], loss)


def slow_buckets(text):
    """Hashes of n-grams one at a time."""
    padded, out = f" {(text or '').lower()} ", set()
    for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
        for i in range(len(padded) - n + 1):
            h = 2166136261
            for c in padded[i : i + n]:
                h = (h ^ ord(c)) * 16777619 % (1 << 32)
                h ^= h >> 15
            out.add(h * 0x9E3779B1 % (1 << 32) >> (32 - toxicity.BITS))
    return out


TEXTS = ["", None, "a", "Zug um Zug", "idiot you IDIOT", "ну и ну", "a long text " * 30, "\U0001f600 smile", "you are kind", "kind regards"]


def test_features_equal_definition():
    rows, buckets = toxicity.features(TEXTS)
    got = [set(buckets[rows == i].tolist()) for i in range(len(TEXTS))]
    assert got == [slow_buckets(t) for t in TEXTS]
    wanted = np.zeros(1 << toxicity.BITS, bool)
    wanted[list(slow_buckets("idiot"))] = True
    rows, buckets = toxicity.features(TEXTS, wanted)
    assert [set(buckets[rows == i].tolist()) for i in range(len(TEXTS))] == [slow_buckets(t) & slow_buckets("idiot") for t in TEXTS]


def test_classifier_equals_plain_twin(spark, monkeypatch):
    import random

    monkeypatch.setattr(toxicity, "STEPS", 80)
    rng = random.Random(4)
    mild, foul = ["tea", "garden", "walk", "river", "book"], ["idiot", "moron", "scum"]
    data = []
    for i in range(300):
        words = [rng.choice(mild) for _ in range(8)]
        if i % 3 == 0:
            words[rng.randrange(8)] = rng.choice(foul)
        data.append((i, " ".join(words), int(i % 3 == 0 and i % 30 != 0)))
    docs = spark.createDataFrame([(f"d{i}", t) for i, t, _ in data], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", y) for i, _, y in data], "doc_id string, toxic int")
    weights, bias = toxicity.trained(docs, labels)
    import zlib

    learnt = [(slow_buckets(t), y) for i, t, y in data if zlib.crc32(f"d{i}".encode()) % 5]
    n1, n0 = ({}, {})
    for buckets, y in learnt:
        for b in buckets:
            n = n1 if y else n0
            n[b] = n.get(b, 0) + 1
    kinds = set(n1) | set(n0)
    s1, s0 = sum(n1.values()) + len(kinds), sum(n0.values()) + len(kinds)
    ratio = {b: np.log((n1.get(b, 0) + 1) / s1) - np.log((n0.get(b, 0) + 1) / s0) for b in kinds}
    kept = sorted(b for b, r in ratio.items() if abs(r) >= 3 * np.sqrt(1 / (n1.get(b, 0) + 1) + 1 / (n0.get(b, 0) + 1)))
    assert np.flatnonzero(weights).tolist() == kept
    # At the optimum of the penalised loss every slope is zero.
    r = np.array([ratio[b] for b in kept])
    x = np.array([[b in buckets for b in kept] for buckets, _ in learnt]) * r
    y = np.array([y for _, y in learnt])
    w = weights[kept] / r
    error = 1 / (1 + np.exp(-(x @ w + bias))) - y
    assert np.abs(x.T @ error / len(y) + toxicity.SHRINK * (w - w.mean())).max() < 1e-4 and abs(error.mean()) < 1e-4
