"""Neighbours of repeated query rows."""

import numpy as np

from assayer.llm import neighbours


def test_every_copy_of_a_query_row_gets_all_its_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((40, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors, 1)]
    # Three equal rows of query 0, and so many other rows of query 100 that they would take all places.
    rows += [(0, vectors[0].tolist())] * 3 + [(100, (vectors[1] + i * 1e-3).tolist()) for i in range(14)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    for query, copies in ((0, [vectors[0]] * 3), (100, [vectors[1] + i * 1e-3 for i in range(14)])):
        want = []
        for q in copies:
            d = sorted((float(np.linalg.norm(np.array(v) - q)), i) for i, v in rows if i != query)
            want += [(rank, i, round(s, 9)) for rank, (s, i) in enumerate(d[: neighbours.TOP], 1)]
        assert sorted(got[query]) == sorted(want)
