import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality as Q


def test_held_out_accuracy(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = Q.score_quality(docs, Q.fit_quality(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_compiled_score_equals_the_model(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    model = Q.fit_quality(docs, labels)
    stats = Q.statistics(F.col("text"))
    for r in docs.select(model.score(stats).alias("score"), *(c.alias(k) for k, c in stats.items())).collect():
        z = model.intercept + sum(x.weight for x in model.rules if all((r[n] > b) == up for n, up, b in x.conditions))
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_statistics(spark):
    rows = spark.createDataFrame([("a a a b",), ("x | y | z",), ("",), (None,), ("HI!! THERE!! 12\n",)], "text string")
    got = [r.asDict() for r in rows.select(*(c.alias(k) for k, c in Q.statistics(F.col("text")).items())).collect()]
    assert got[0]["repeated"] == 0.5 and got[1]["bars"] == 0.4 and got[2] == got[3] and got[2]["words"] == 0
    assert got[4]["shouts"] == 2 / 3 and got[4]["numbers"] == 1 / 3 and got[4]["lines"] == 1 / 16


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, 0.5), (1, "", 0.1), (1, "word " * 50_000, 0.2)], "doc_id long, text string, score double")
    for labels in ([], [(1, 1)], [(None, 0), (1, None), (1, 7)]):
        model = Q.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        out = Q.score_quality(docs, model)
        assert sorted(out.columns) == ["doc_id", "held_out", "predicted", "score", "text"] and all(0 <= r["score"] <= 1 for r in out.collect())
    assert Q.score_quality(docs.limit(0), model).count() == 0


def test_rules_are_sparse():
    r = np.random.default_rng(5)
    x = r.random((800, 6))
    y = ((x[:, 2] > 0.6) & (x[:, 4] <= 0.5)).astype(float)
    model = Q.fit_rules(x, y, list("abcdef"))
    z = np.full(800, model.intercept)
    for rule in model.rules:
        z += rule.weight * np.all([(x[:, "abcdef".index(n)] > b) == up for n, up, b in rule.conditions], axis=0)
    assert np.mean((z > 0) == (y > 0)) > 0.97 and len(model.rules) < 80


def test_a_filter_on_predicted_counts_once(spark, tiny):
    """However many rules there are, a filter that Spark moves below the score has each pattern once, and its code stays small."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rules = tuple(Q.Rule((("bars", True, k / 100), ("numbers", False, k / 50)), 0.1) for k in range(40))
    scored = Q.score_quality(docs, Q.RuleEnsemble(0.5, rules))
    kept = scored.where("predicted = 1").select(*docs.columns)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in (Q._PER_WORD["bars"], Q._PER_WORD["numbers"])] == [1, 1]
    assert kept.count() == sum(r["predicted"] for r in scored.select("predicted").collect())
