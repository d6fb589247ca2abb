"""Searches for every fiftieth row."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.plans import catalogue


def test_every_fiftieth_row_asks(spark, tiny):
    ids = {r[0] for t, c in (("documents", "doc_id"), ("embeddings", "vec_id")) for r in spark.read.parquet(f"{tiny}/{t}.parquet").where(f"{c} % 50 = 0").select(c).collect()}
    asked = {r["query_id"]: r for r in catalogue.every_query(spark, tiny).collect()}
    assert set(asked) == ids and len(ids) > 3 and any(r["query"] for r in asked.values())
    assert {r["query_id"] for r in catalogue.queries()["mmr_search"](spark, tiny).select("query_id").distinct().collect()} == ids
    assert {r["query_id"] for r in catalogue._sweep_golden(spark, tiny).collect()} == ids


def test_no_vector_of_three_ids(spark, tiny, tmp_path):
    for name in ("documents", "embeddings"):
        rows = spark.read.parquet(f"{tiny}/{name}.parquet")
        rows.where(F.col(rows.columns[0]) > 3).write.parquet(f"{tmp_path}/{name}.parquet")
    assert catalogue.queries()["match_spans"](spark, str(tmp_path)).count() > 0


def test_cut_of_a_task_keeps_the_best(spark):
    r = np.random.default_rng(3)
    words = ["river", "mill", "stone", "grain"]
    rows = [(k, None, None, " ".join(r.choice(words, r.integers(1, 6)))) for k in range(3000)]
    chunks = spark.createDataFrame(rows, "id long, heading string, context_text string, content string").repartition(2)
    queries = spark.createDataFrame([(k, w) for k, w in enumerate([*words, "river mill", "none here"])], "query_id long, query string")
    weights = retrieval.weight_table(spark, (1.0, 1.0, 1.0), (2.0, 1.0, 3.0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(x["query_id"], x["weight_id"], x["rank"], x["chunk_id"]) for x in retrieval.bm25(chunks, queries, weights, 7).collect()}
        want = {(x["query_id"], x["weight_id"], x["rank"], x["chunk_id"]) for x in retrieval.bm25(chunks, queries, weights).collect() if x["rank"] < 7}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == 5 * 2 * 7
