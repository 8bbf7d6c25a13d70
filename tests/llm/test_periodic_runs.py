import hashlib
import random
import zlib

import numpy as np
import pytest

from assayer.llm import periodic_runs as pr


def brute_runs(words):
    """(start, length, period) of all runs: maximal stretches of each period, of equal ones the least period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(pr.LEAST, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def got(df):
    return sorted((tuple(r) for r in pr.digested(pr.with_runs(pr.damaged(df))).collect()), key=str)


def random_words(rng, longest):
    """Random words over few letters, with powers of random words in between."""
    letters = rng.randint(1, 5)
    out = []
    while len(out) < longest:
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        out += part * rng.choice([1, 1, 2, 3, 6])
        if rng.random() < 0.1:
            out += out[-rng.randint(1, len(out)) :]
    return out[:longest]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [random_words(rng, rng.randint(0, 150)) for _ in range(rng.randint(1, 6))]
        words = np.array([w for t in texts for w in t], np.int64)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        starts = np.cumsum([0, *map(len, texts)])
        want = [(int(s) + a, int(s) + a + n, q) for s, t in zip(starts, texts, strict=False) for a, n, q in sorted(brute_runs(t), key=lambda r: (r[0], r[2]))]
        assert [tuple(r) for r in pr.runs_of(words, of).tolist()] == want


def test_long_periods_and_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    rng = random.Random(9)
    block = [rng.randrange(50) for _ in range(400)]
    for words in (b, [7] * 900, block * 3 + block[:57], [0, 1] * 300 + [0] + [0, 1] * 200, ([5] * 40 + [6]) * 12):
        want = [(s, s + n, q) for s, n, q in sorted(brute_runs(words), key=lambda r: (r[0], r[2]))]
        assert [tuple(r) for r in pr.runs_of(np.array(words), np.zeros(len(words), np.int64)).tolist()] == want


def test_range_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 33, 500):
        values = rng.permutation(n)
        tree = pr.WaveletTree(values)
        low = rng.integers(0, n, 300)
        high = low + rng.integers(1, n + 1, 300)
        high = np.minimum(high, n)
        least = rng.integers(0, n + 2, 300)
        want = [min((v for v in values[a:b].tolist() if v >= x), default=-1) for a, b, x in zip(low, high, least, strict=True)]
        assert tree.successor(low, high, least).tolist() == want


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = rows.filter("length(text) < 30000")
    assert got(short) == sorted(((r.doc_id, *brute(r.doc_id, r.text)) for r in short.collect()), key=str)
    assert pr.query(spark, "/root/testdata/sf0.001").count() == rows.count()


def test_edges(spark):
    schema = "doc_id string, text string, runs int, collapsed string"
    assert got(spark.createDataFrame([], schema)) == []
    lines = "the same line again\n" * 40
    periodic = next(str(i) for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(None, None), ("a", ""), ("b", " \t\v\f\r\n "), ("c", lines), ("c", lines), ("d", "x" * 200000), ("e", "w " * 20000), (periodic, "one two three"), (periodic, None), ("f", "a b " * 6 + "é " * 12)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], schema)
    want = [(i, *(brute(i, t) if i != "e" else (1, 0, 20000, 1, 20_000_000, hashlib.sha256(b"0,20000,1\n").hexdigest(), hashlib.sha256(b"w").hexdigest()))) for i, t in rows]
    assert zlib.crc32(b"e") % 10
    assert got(frame) == sorted(want, key=str)
