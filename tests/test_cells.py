"""Vectors by cell against a full search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.sources.cells import open_cells, write_cells


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    r = np.random.default_rng(0)
    c = r.normal(size=(30, 6)) * 10
    x = (c[r.integers(0, 30, 3000)] + r.normal(size=(3000, 6))).astype(np.float32)
    x[50] = x[60]
    odd = [(9000, [1.0]), (9001, []), (9002, [float("nan")] * 6), (9003, [None, 1.0, 1.0, 1.0, 1.0, 1.0])]
    v = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)] + odd, "chunk_id long, embedding array<float>").repartition(3)
    folder = str(tmp_path_factory.mktemp("cells"))
    write_cells(v, folder)
    q = spark.createDataFrame([(k, x[k * 7].tolist()) for k in range(40)] + [(100, [2.0]), (101, [])], "query_id long, vector array<float>")
    return v, open_cells(spark, [folder]), q


@pytest.mark.parametrize("k", [1, 100, 4000])
def test_equals_the_full_search(data, k):
    v, cells, q = data
    got, want = (sorted(map(str, retrieval.knn(v, q, k, c).collect())) for c in (cells, None))
    assert got == want


def test_far_cells_are_not_read(data):
    v, cells, q = data
    rows = retrieval.cells_read(cells, v, q.where("query_id < 100"), 5)
    r = rows.agg(F.avg("cells_read").alias("read"), F.avg("cells").alias("all"), F.avg("vectors_read").alias("n")).first()
    assert r["read"] < r["all"] / 3 and r["n"] < 1000


def test_radius_holds_all_members(data):
    _, cells, _ = data
    most = {r["cell"]: r["m"] for r in cells.rows.groupBy("cell").agg(F.max("gap").alias("m")).collect()}
    assert all(not center or most[cell] == radius for cell, center, radius, _ in cells.cells)
    assert sum(n for *_, n in cells.cells) == 3004


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    write_cells(none, str(tmp_path / "c"))
    q = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    assert retrieval.knn(none, q, 3, open_cells(spark, [str(tmp_path / "c")])).count() == 0
