"""Nearest neighbours among many equal vectors."""

import numpy as np

from quarry.operators import retrieval


def test_ties_go_to_the_smaller_id(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 64)).astype(np.float32)
    x[:800:2] = x[0]
    v = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "chunk_id long, embedding array<float>").coalesce(1)
    q = [(7, x[0].tolist()), (8, (x[0] + np.float32(0.01)).tolist()), (9, x[1].tolist())]
    got = retrieval.knn(v, spark.createDataFrame(q, "query_id long, vector array<float>"), 10).collect()
    for query_id, vector in q:
        d = np.sqrt(((x.astype(float) - np.array(vector)) ** 2).sum(1))
        want = sorted(range(2000), key=lambda i: (d[i], i))[:10]
        assert [g["chunk_id"] for g in sorted((g for g in got if g["query_id"] == query_id), key=lambda g: g["rank"])] == want


def test_more_neighbours_than_vectors(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [float("nan"), 0.0])], "chunk_id long, embedding array<float>")
    got = retrieval.knn(v, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>"), 5).orderBy("rank").collect()
    assert [g["chunk_id"] for g in got] == [1, 3, 2]
