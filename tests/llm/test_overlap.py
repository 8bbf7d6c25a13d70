"""Near-duplicates of the pipeline: 5-word shingles, similarity 0.8 or more."""

import random

import corpus_pipeline
import pytest

from assayer.llm import overlap


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(texts):
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    texts = [None, "", " \n", "One two", "one TWO", "one two three"]
    for n in (30, 60, 120, 400, 400):
        base = [rng.choice(words) for _ in range(n)]
        texts.append(" ".join(base))
        for share in (0.004, 0.01, 0.02, 0.03):
            for _ in range(4):
                copy = list(base)
                for at in rng.sample(range(n), max(1, int(n * share))):
                    copy[at] = rng.choice(words)
                texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("group", [4, 1024])
def test_groups_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(overlap, "GROUP", group)
    texts = rows()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in overlap.near_duplicates(df).collect()}
    root = brute_groups(texts)
    assert got == {i: root.index(g) for i, g in enumerate(root)}


def test_stage_drops_pairs_at_point_eight(spark):
    words = [f"w{i}" for i in range(180)]
    near = list(words)
    near[20] = near[60] = near[110] = "x"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "something else"), (None, "something else")], "doc_id long, text string")
    assert 0.8 <= len(brute_set(" ".join(words)) & brute_set(" ".join(near))) / len(brute_set(" ".join(words)) | brute_set(" ".join(near))) < 0.9
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3]


def test_empty_table(spark):
    assert overlap.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_that_is_a_third_of_all_rows(spark):
    """Copies and near copies of one text, in many partitions; nulls, repeated rows and columns that clash."""
    rng = random.Random(5)
    base = [f"v{i}" for i in range(90)]
    hot = " ".join(base)
    near = [" ".join(["x" if i == at else w for i, w in enumerate(base)]) for at in (0, 40, 89)]
    texts = [hot] * 300 + near * 20 + [None] * 30 + [" ".join(rng.choices(base, k=60)) for _ in range(200)]
    ids = [i if i % 50 else None for i in range(len(texts))]
    rows = [(i, t, 1, 2, "k") for i, t in zip(ids, texts, strict=True)]
    rows += [(7, hot, 1, 2, "k")] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int, node int, kind string").repartition(9)
    got = sorted(((r.doc_id, r.component_id) for r in overlap.near_duplicates(df).collect()), key=str)
    distinct = list(dict.fromkeys(t or "" for _, t, *_ in rows))
    root = dict(zip(distinct, brute_groups(distinct), strict=True))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            g = root[t or ""]
            least[g] = min(i, least.get(g, i))
    assert got == sorted(((i, least.get(root[t or ""])) for i, t, *_ in rows), key=str)
