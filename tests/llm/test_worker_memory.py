"""What a Python worker of the pipeline holds beside the batch that it reads."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quarry.llm import suffix_dedup as S


def made(n=1500, size=4000, seed=3):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(97, 123, size, np.uint8).tobytes().decode() for _ in range(n)]
    texts[7] = texts[3]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], names=["id", "text"])


def test_runs_of_a_batch_take_little_beside_it():
    batch = made()
    tracemalloc.start()
    try:
        out = list(S._find_runs(4)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 5  # a blob for each bucket, and the copy
    assert peak < 10 * batch.nbytes, peak / batch.nbytes


def test_batches_of_any_size_are_settled_together():
    batch = made(300)
    out = list(S._find_runs(4)(iter([batch.slice(k, 30) for k in range(0, 300, 30)])))
    assert sum(b.num_rows for b in out) == 5


def test_parts_of_the_input_meet(monkeypatch):
    """What is settled apart gives the same spans."""
    batch = made(60)

    def spans():
        found = pa.Table.from_batches(S._find_runs(1)(iter([batch.slice(k, 2) for k in range(0, 60, 2)])))
        met = pa.Table.from_batches(S._meet_runs(found.drop_columns("bucket")))
        known = met.filter(pa.array(met.column("kind").to_numpy() == 1))
        got = {}
        for i, b in zip(known.column("id").to_pylist(), known.column("blob").to_pylist(), strict=True):
            got.setdefault(i, []).append(np.frombuffer(b, np.int64).reshape(-1, 2))
        return {i: S._merged(*np.concatenate(p).T).tolist() for i, p in got.items()}

    together = spans()
    monkeypatch.setattr(S, "GATHERED", 1)
    assert spans() == together == {7: [[0, 4000]]}


def test_batches_to_workers_are_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quarry import storage

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 1000).alias("text"))
    try:
        monkeypatch.setattr(storage, "BATCH_BYTES", 1 << 16)
        S.remove_repeats(docs).count()
        assert spark.conf.get(name) == str(1 << 16)
        sizes = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in bs), "n long").collect()
        assert max(r["n"] for r in sizes) < 1 << 17
        spark.conf.set(name, "1000")  # a smaller limit of the user's stays
        S.remove_repeats(docs)
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)
