import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from assayer.llm import exact_repeats as er
from assayer.llm.suffixes import common_prefixes, left_in_part, suffix_array


def brute(texts):
    """Per text: bytes, removed bytes, removed runs, digest of the rest."""
    raw = [(t or "").encode() for t in texts]
    n = er.LEAST
    seen = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    rows = er.repeats(df).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans) AS n_spans", "sha2(kept, 256) AS kept").collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in rows), key=str)


def corpus(seed, texts):
    rng = random.Random(seed)
    words = [rng.choice(["é", "ab", "xy", "", "q"]) + str(rng.randint(0, 10**6)) for _ in range(4000)]
    passages = [" ".join(rng.choices(words, k=rng.randint(15, 120))) for _ in range(8)] + ["ab" * 300, "z" * 450]
    out = []
    for _ in range(texts):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                parts.append(" ".join(rng.choices(words, k=rng.randint(0, 60))))
            else:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 2)
                parts.append(p[a : a + rng.randint(150, 600)] if kind < 0.9 else p)
        out.append(rng.choice([" ", ""]).join(parts))
    return [*out, None, "", out[0], "short", "short", "x" * 199, "x" * 200, "y" * 201, "y" * 200]


@pytest.mark.parametrize(("seed", "block"), [(1, 4_000_000), (2, 3000), (3, 400)])
def test_equals_counting_all_windows(spark, monkeypatch, seed, block):
    monkeypatch.setattr(er, "BLOCK_BYTES", block)
    texts = corpus(seed, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert found(df) == sorted(((i, *r) for i, r in enumerate(brute(texts))), key=str)


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    told = rows.collect()
    assert found(rows) == sorted(((r.doc_id, *b) for r, b in zip(told, brute([r.text for r in told]), strict=True)), key=str)


def test_edges(spark):
    schema = "doc_id string, text string, n_bytes int, spans int"
    assert er.repeats(spark.createDataFrame([], schema)).count() == 0
    long = "".join(chr(97 + (i * i) % 23) for i in range(30000))
    rows = [(None, "same " * 60, 1, 1)] * 2 + [("a", long, 1, 1), ("b", "é" * 99 + "x", 1, 1), ("b", "ü" * 99 + "x", 1, 1), ("c", None, 1, 1)]
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True)]
    assert found(spark.createDataFrame(rows, schema)) == sorted(want, key=str)


def test_one_text_is_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(er, "BLOCK_BYTES", 5000)
    texts = [f"{'common passage ' * 20}" if i % 3 == 0 else " ".join(str(i * 7919 + j) for j in range(40 + i % 9)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert found(df) == sorted(((i, *r) for i, r in enumerate(brute(texts))), key=str)


@pytest.mark.parametrize("span", [1, 8])
def test_suffixes_and_prefixes(span):
    rng = np.random.default_rng(7)
    for n, letters in ((1, 2), (50, 2), (400, 2), (300, 1), (3000, 20)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        text[n // 2 : n // 2 + n // 4] = text[: n // 4]
        ends = np.unique(np.append(rng.integers(1, n + 1, 1 + n // 90), n))
        left = left_in_part(ends, n)
        if span == 1:
            words = text.astype(np.int64)
        else:
            part = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            spread = np.full(n + 8 * len(ends) + 8, 0xFF, np.uint8)
            spread[np.arange(n) + 8 * part] = text
            words = er.words_of(spread)[np.arange(n) + 8 * part]
        order, rank = suffix_array(words, left, span)
        key = lambda i: [*text[i : i + left[i]].tolist(), 1000 + i + left[i]]  # noqa: B023, E731
        want = sorted(range(n), key=key)
        assert order.tolist() == want
        assert rank[order].tolist() == list(range(n))
        shared = [0]
        for a, b in zip(want, want[1:], strict=False):
            m = 0
            while m < min(left[a], left[b]) and text[a + m] == text[b + m]:
                m += 1
            shared.append(m)
        assert common_prefixes(order, words, left, span).tolist() == shared
        assert common_prefixes(order, words, left, span, 9).tolist() == [min(x, 9) for x in shared]
