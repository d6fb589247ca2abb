import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.model import Corpus, Filters, GraphOptions, Mmr, Parent
from quarry.operators import evaluation, graph, refine, retrieval, tuning


def corpus_of(spark, texts, dim=4, seed=1):
    """A document for each list of texts, with random vectors."""
    r = random.Random(seed)
    docs = [(d, f"cat/top/{d}.md", f"T{d}", "top", "cat", None, ["x"], "2024-01-01", "h", "now", 10) for d in range(len(texts))]
    chunks = [(d * 100 + k, d, k, None, None, t, len(t.encode()) // 4, 1.0, None) for d, ts in enumerate(texts) for k, t in enumerate(ts)]
    vectors = [(c[0], [r.uniform(-1, 1) for _ in range(dim)]) for c in chunks]
    return Corpus(
        spark.createDataFrame(docs, "id long, path string, title string, topic string, category string, depth string, tags array<string>, date string, content_hash string, last_indexed string, size_bytes long"),
        spark.createDataFrame(chunks, "id long, document_id long, chunk_index int, heading string, level int, content string, token_count int, quality_score double, context_text string"),
        spark.createDataFrame(vectors, "chunk_id long, embedding array<float>"),
    )


def test_knn(spark):
    r = np.random.default_rng(1)
    x, q = r.normal(size=(200, 6)).astype(np.float32), r.normal(size=(3, 6)).astype(np.float32)
    x[50] = x[60]
    v = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)] + [(999, [1.0])], "chunk_id long, embedding array<float>").repartition(3)
    got = retrieval.knn(v, spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(q)], "query_id long, vector array<float>"), 7).collect()
    for k in range(3):
        d = np.linalg.norm(x.astype(float) - q[k].astype(float), axis=1)
        want = sorted(range(200), key=lambda i: (d[i], i))[:7]
        assert [r["chunk_id"] for r in sorted((g for g in got if g["query_id"] == k), key=lambda g: g["rank"])] == want
    assert retrieval.knn(v, spark.createDataFrame([], "query_id long, vector array<float>"), 7).count() == 0


def test_bm25_counts_overlaps_and_folds(spark):
    kb = corpus_of(spark, [["aaaa Déjà vu"], ["deja"], ["nothing"]])
    q = spark.createDataFrame([(1, ["aaa"]), (2, ["déjà"])], "query_id long, phrases array<string>")
    got = {(r["query_id"], r["chunk_id"]): r["bm25"] for r in retrieval.bm25(kb.chunks, q, retrieval.weight_table(spark, (2.0, 1.0, 1.0))).collect()}
    assert set(got) == {(1, 0), (2, 0), (2, 100)}
    sizes = [len("aaaa Déjà vu") - 2, 2, len("nothing") - 2]
    idf, tf = math.log((3 - 1 + 0.5) / 1.5), 2
    assert abs(got[1, 0] + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[0] / (sum(sizes) / 3)))) < 1e-12
    assert abs(got[2, 0]) < 1e-5  # two of three rows match: the weight is floored


def test_rrf_total_order(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 10, 1), (1, 12, 2)], "query_id long, chunk_id long, rank int")
    got = [(r["chunk_id"], r["rank"]) for r in retrieval.fuse([a, b], 60).orderBy("rank").collect()]
    assert got == [(10, 0), (11, 1), (12, 2)]


def slow_mmr(x, rel, docs, limit, lam, penalty):
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    out = []
    while len(out) < min(limit, len(x)):
        best, value = None, -math.inf
        for i in range(len(x)):
            if i not in out:
                v = lam * rel[i] - (1 - lam) * max((cos(x[i], x[j]) for j in out), default=0) - penalty * any(docs[i] == docs[j] for j in out)
                if v > value + 1e-12:
                    best, value = i, v
        out.append(best)
    return out


@pytest.mark.parametrize("lam", [0.0, 0.7, 1.0])
def test_mmr(lam):
    r = np.random.default_rng(2)
    x, rel, docs = r.normal(size=(40, 5)), r.random(40), np.arange(40) // 3
    assert refine.select_diverse(x, rel, docs, 12, lam, 0.2) == slow_mmr(x, rel, docs, 12, lam, 0.2)


def test_diversify_and_confidence(spark):
    kb = corpus_of(spark, [["a", "b"], ["c"], ["d"]])
    hits = spark.createDataFrame([(1, 0, 0, 0, 0.9), (1, 1, 0, 1, 0.8), (1, 100, 1, 2, 0.1), (1, 777, 9, 3, 0.1)], "query_id long, chunk_id long, document_id long, rank int, score double")
    out = refine.diversify(hits, kb.vectors, 3, Mmr(enabled=True)).orderBy("rank").collect()
    assert len(out) == 3 and out[0]["chunk_id"] == 0 and 777 not in {r["chunk_id"] for r in out}
    assert refine.low_confidence(hits).first()["low_confidence"] is False
    assert refine.low_confidence(hits.withColumn("score", F.lit(1.0))).first()["low_confidence"] is True
    assert refine.low_confidence(hits.limit(1)).first()["low_confidence"] is False


def test_expand(spark):
    long = "word " * 200
    kb = corpus_of(spark, [["tiny", "next one", "third"], [long, long, long]])
    hits = retrieval.attach(spark.createDataFrame([(1, 0, 1.0, 0), (1, 101, 0.5, 1)], "query_id long, chunk_id long, score double, rank int"), kb)
    out = {r["chunk_id"]: r for r in refine.expand(hits, kb.chunks, Parent(enabled=True, whole_document_below=100, max_tokens=300)).collect()}
    assert out[0]["content"] == "tiny\n\nnext one\n\nthird" and out[0]["expanded_from"]["total_chunks"] == 3
    assert out[101]["content"] == long and (out[101]["expanded_from"]["from_index"], out[101]["expanded_from"]["to_index"]) == (1, 1)
    wide = {r["chunk_id"]: r for r in refine.expand(hits, kb.chunks, Parent(enabled=True, whole_document_below=100, max_tokens=8000)).collect()}
    assert wide[101]["expanded_from"]["kind"] == "adjacent" and wide[101]["content"].count(long) == 3


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 0, "a", " H "), (1, 1, "b", None), (1, 2, "a", None), (2, 0, "x", None)], "query_id long, rank int, path string, heading string")
    golden = spark.createDataFrame([(1, [("b", None), ("a", "h"), ("z", None)]), (2, [("y", None)]), (3, [])], "query_id long, expected array<struct<path:string,heading:string>>")
    got = {(r["query_id"], r["metric"], r["k"]): r["value"] for r in evaluation.metrics(hits, golden, (1, 2)).collect()}
    assert got[1, "recall", 1] == 1 / 3 and got[1, "recall", 2] == 2 / 3 and got[1, "rr", 0] == 1.0 and got[2, "rr", 0] == 0.0
    assert got[1, "ndcg", 2] == 1.0 and got[2, "ndcg", 1] == 0.0 and not any(q == 3 for q, *_ in got)
    assert evaluation.ndcg_of(["a", "a"], [None, None], [("a", None)], 2) == 1.0
    assert evaluation.k_values((5, 5, 0, 9999), 3) == ((1, 5, 1000), 1000)


def test_regressions_and_history(spark):
    now = spark.createDataFrame([("rr", 0, 0.5), ("ndcg", 5, float("nan"))], "metric string, k int, value double")
    before = spark.createDataFrame([("rr", 0, 0.6), ("ndcg", 5, 0.9)], "metric string, k int, value double")
    assert [r["metric"] for r in evaluation.regressions(now, before).collect()] == ["rr"]
    runs = spark.createDataFrame([(k, f"2024-01-{k:02d}") for k in range(1, 10)], "run_id int, started string")
    kept = evaluation.keep_history(runs, spark.createDataFrame([(10, "2024-02-01")], "run_id int, started string"), 3)
    assert sorted(r["run_id"] for r in kept.collect()) == [8, 9, 10]
    f = evaluation.Fingerprint("m", "none", 5, (1, 5), "g")
    assert f.digest() == evaluation.Fingerprint("m", "none", 5, (1, 5), "g").digest() != evaluation.Fingerprint("m", "none", 6, (1, 5), "g").digest()
    assert evaluation.corpus_change({"documents": 1, "chunks": 2, "content": "a"}, {"documents": 1, "chunks": 2, "content": "b"})


def test_quotes(spark):
    kb = corpus_of(spark, [["The first long query here and\nthe second long   QUERY too"], ["the first long query here"]])
    e = "array<struct<path:string,heading:string>>"
    g = spark.createDataFrame([(0, "the first long query", []), (1, "The second long query", []), (2, "long query", []), (3, "THE FIRST long query", [])], f"query_id long, query string, expected {e}")
    assert [(r["path"], r["needles"], r["queries"]) for r in evaluation.quoted_queries(kb, g).collect()] == [("cat/top/0.md", 2, [0, 1])]
    g2 = g.withColumn("expected", F.array(F.struct(F.lit("cat/top/0.md").alias("path"), F.lit(None).cast("string").alias("heading"))))
    assert evaluation.quoted_queries(kb, g2).count() == 0


def test_selection_and_decision():
    n, d = 384, tuning.default_condition()
    assert len(tuning.grid()) == n and tuning.select(np.zeros(n)) == d
    means = np.zeros(n)
    means[100] = 0.0
    best = (0 * 6) + d % 6
    means[best] = 1.0
    assert tuning.select(means) // 6 == 0
    values = np.zeros((20, n))
    assert not tuning.decide(values)["adopt"]
    values[:, best] = 0.5 + np.random.default_rng(1).normal(0, 0.01, 20)
    out = tuning.decide(values)
    assert out["adopt"] and out["condition"] == best and out["stability"] == 1.0
    values[0] = np.nan
    assert not tuning.decide(values)["adopt"]
    assert tuning.sign_test(np.array([1.0] * 5 + [0.0])) == 2 / 32 and tuning.standard_error(np.array([1.0])) == math.inf
    assert tuning.sweep_ks((1, 0, -3)) == ((1, 5), 5)
    with pytest.raises(ValueError):
        tuning.sweep_ks((10_001,))


def slow_graph(vectors, path_of, start, o):
    """chunk ids in order of admission, by a plain queue."""
    own = sorted(c for c in vectors if path_of[c] == start)[: o.max_seeds]
    nodes, queue, seen = [(c, 0) for c in own[: o.max_nodes]], [(c, 0) for c in own[: o.max_nodes]], set(own)
    while queue:
        c, depth = queue.pop(0)
        if depth >= o.depth or len(nodes) >= o.max_nodes:
            continue
        near = sorted(vectors, key=lambda x: (np.linalg.norm(vectors[x] - vectors[c]), x))[: 2 * o.fan_out]
        added = 0
        for x in near:
            s = min(1, max(0, 1 - np.linalg.norm(vectors[x] - vectors[c]) ** 2 / 2))
            if x in seen or path_of[x] == start or s < o.min_similarity or added >= o.fan_out or len(nodes) >= o.max_nodes:
                continue
            seen.add(x)
            nodes.append((x, depth + 1))
            queue.append((x, depth + 1))
            added += 1
    return nodes


@pytest.mark.parametrize("most", [12, 100])
def test_graph(spark, most):
    kb = corpus_of(spark, [["t%d" % k for k in range(3)] for _ in range(14)], dim=3)
    vectors = {r["chunk_id"]: np.array(r["embedding"], float) for r in kb.vectors.collect()}
    o = GraphOptions(min_similarity=0.1, fan_out=3, max_nodes=most)
    g = graph.connection_graph(kb, "cat/top/2.md", o)
    assert [(n.chunk_id, n.depth) for n in g.nodes] == slow_graph(vectors, {c: f"cat/top/{c // 100}.md" for c in vectors}, "cat/top/2.md", o)
    assert g.knn_queries <= len(g.nodes) <= most and graph.to_dot(g).count("->") == sum(n.parent_id is not None for n in g.nodes)
    assert graph.to_svg(g).count("<rect") == len(g.nodes) and graph.to_text(g) and graph.to_json(g)
    c = graph.connection_graph(kb, "cat/top/2.md", GraphOptions(strategy="centroid", min_similarity=0.1, dedup_by_path=True))
    paths = [n.path for n in c.nodes[1:]]
    assert c.nodes[0].chunk_id == 200 and c.seeds_used == 3 and len(set(paths)) == len(paths)
    assert graph.connection_graph(kb, "cat/top/2.md", GraphOptions(max_nodes=0)).nodes == [] and graph.connection_graph(kb, "no.md").nodes == []


def test_sweep_default_equals_search(spark):
    from quarry.model import Fusion, SearchOptions
    from quarry.plans.search import search

    kb = corpus_of(spark, [[f"alpha beta {k}", f"beta gamma {k}", "alpha only"] for k in range(6)])
    q = spark.createDataFrame([(1, "alpha beta", [0.1, 0.2, 0.3, 0.4])], "query_id long, query string, vector array<float>")
    g = spark.createDataFrame([(1, "q", [("cat/top/1.md", None)])], "query_id long, query string, expected array<struct<path:string,heading:string>>")
    swept = tuning.sweep(kb, q, g, Filters(), 5).where(F.col("condition") == tuning.default_condition())
    want = search(kb, q, SearchOptions(limit=5, fusion=Fusion()))
    pick = lambda df: [(r["chunk_id"], r["rank"]) for r in df.orderBy("rank").collect()]
    assert pick(swept) == pick(want)
    assert tuning.preflight(kb, q).first()["effective"] and tuning.context_is_void(kb)
