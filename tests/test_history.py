"""Recorded runs: order, byte budget, predecessors."""

import pytest

from quarry.operators.evaluation import Fingerprint, Run
from quarry.sources import history


def run_of(spark, value, queries=3):
    metrics = spark.createDataFrame([(q, "rr", 0, value) for q in range(queries)], "query_id long, metric string, k int, value double")
    aggregate = spark.createDataFrame([("rr", 0, value, queries)], "metric string, k int, value double, queries long")
    return Run(None, metrics, aggregate, spark.createDataFrame([(1, 2, "c")], "documents long, chunks long, content string"), (1,), 5)


def ids(spark, folder):
    return [r[0] for r in history.load_history(spark, folder).select("run_id", "started").distinct().orderBy("started").collect()]


def test_history(spark, tmp_path):
    folder, f, g = str(tmp_path / "h"), Fingerprint("m", "none", 5, (1,), "g"), Fingerprint("m", "none", 6, (1,), "g")
    assert history.load_history(spark, folder).count() == 0
    assert history.record_run(spark, folder, run_of(spark, 0.9), f, "a", "2024-01-01") is None
    assert [(r["metric"], r["before"], r["now"]) for r in history.record_run(spark, folder, run_of(spark, 0.5), f, "b", "2024-01-02").collect()] == [("rr", 0.9, 0.5)]
    assert history.record_run(spark, folder, run_of(spark, 0.4), g, "c", "2024-01-03") is None  # other settings
    assert history.record_run(spark, folder, run_of(spark, 0.1), f, "d", "2024-01-04") is None  # the last run had other settings, the ones before don't count
    assert ids(spark, folder) == ["a", "b", "c", "d"] and len(history.history_versions(spark, folder)) == 2
    history.record_run(spark, folder, run_of(spark, 0.1), f, "e", "2024-01-05", runs=3)
    assert ids(spark, folder) == ["c", "d", "e"]
    one = history._sizes(history.load_history(spark, folder)).first()["bytes"]
    history.record_run(spark, folder, run_of(spark, 0.1), f, "f", "2024-01-06", budget=2 * one + 10)
    assert ids(spark, folder) == ["e", "f"]
    with pytest.raises(ValueError, match="the history at most"):
        history.record_run(spark, folder, run_of(spark, 0.1, queries=50), f, "g", "2024-01-07", budget=2 * one)
    assert ids(spark, folder) == ["e", "f"]
