import random

import numpy as np
import pytest
import xxhash

from assayer.llm import graph, simhash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints):
    n = len(prints)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


TEXTS = [None, "", " \t\n", "One", "one two", "One TWO three", "a b c d e f", "a b c\x1cd", "É é Ǆ", "a b c d e f", "x y " * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 300]))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += TEXTS
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in zip(ids, rows, strict=True)], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = [brute_print(t) for t in rows]
    groups = brute_groups(prints)
    least = {g: min(i for i, h in zip(ids, groups, strict=True) if h == g) for g in set(groups)}
    assert got == {i: (p - (1 << 64) if p >> 63 else p, least[g]) for i, p, g in zip(ids, prints, groups, strict=True)}


def test_hot_group_is_dealt_out_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    base = 0x0123456789ABCDEF
    values = [base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = graph.components(simhash.links(df), "a", "b").collect()
    assert {r.node for r in roots} == set(values) and {r.root for r in roots} == {min(values)}


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 3)))) for _ in range(5)]))
    groups = brute_groups([int(x) for x in fps])
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = simhash.forest(fps, simhash.pivot_table(fps))
    for a, b in links:
        assert int(fps[a] ^ fps[b]).bit_count() <= 3
        root[find(a)] = find(b)
    assert len({(find(i), g) for i, g in enumerate(groups)}) == len(set(groups)) == len({find(i) for i in range(len(fps))})


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


def test_empty_null_ids_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "z z z z")], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == [(5, 5), (5, 5), (None, 5), (None, None)]
