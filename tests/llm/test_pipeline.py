"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline as P
from tests.llm.test_near_dedup import brute as brute_near
from tests.llm.test_suffix_dedup import brute as brute_repeats


def test_stages(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, tiny).write.parquet(path)
        out = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in out.collect()}
        seen.append((name, len(before), len(after)))
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        if name == "minhash_near_dedup":
            assert set(after) == {i for i, (_, _, kept) in brute_near([(i, r["text"]) for i, r in before.items()], 5, 80).items() if kept}
        if name == "suffix_dedup":
            want = brute_repeats([(i, r["text"]) for i, r in before.items()])
            assert set(after) == set(before)
            for i, (size, gone, *_) in want.items():
                assert size - gone - 3 * want[i][2] - 3 <= len(after[i]["text"].encode()) <= size - gone and after[i]["n_chars"] == len(after[i]["text"])
        if name == "benchmark_decontamination":
            texts = [r["text"] for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
            assert not any(t in r["text"] for t in texts for r in after.values())
        if name == "lattice_encoding":
            assert set(after) == set(before) and all(r["round_trip"] for r in after.values())
        docs = out
    assert len(P.STAGES) == 5 and seen[0][1] == 200 and seen[0][2] > 150, seen


def test_empty(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in P.STAGES[1:]:
        assert stage(spark, docs, tiny).count() == 0


def test_quality_stage_keeps_what_scores_high(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    from quarry.llm.quality import fit_quality, score_quality

    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    scored = {r["doc_id"]: r["score"] for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    kept = {r["doc_id"] for r in P.keep_quality(spark, docs, tiny).collect()}
    assert kept == {i for i, s in scored.items() if s >= 0.7}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & set(scored)
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()} & set(scored)
    assert len(good & kept) > 0.95 * len(good) and len(bad & kept) < 0.5 * max(1, len(bad))


def test_null_and_repeated_ids(spark, tiny):
    """Rows without id and rows that repeat one pass through every stage."""
    base = spark.read.parquet(f"{tiny}/documents.parquet")
    text = "The old mill by the river was built long ago, and people from the village still bring their grain to it every autumn. " * 2
    rows = [(None, text, "en", "s", 1), (5, text, "en", "s", 1), (5, text, "en", "s", 1), (5, "Another text of its own about bread and salt, nothing that the others say.", "en", "s", 1), (6, None, None, None, None), (None, None, "en", "s", 0)]
    docs = base.limit(0).union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*base.columns))
    near = P.drop_near_duplicates(spark, docs, tiny)
    assert sorted(map(str, near.select("doc_id").toPandas()["doc_id"])).__len__() == 6  # rows of one id are one node and stay together
    cut = P.drop_repeats(spark, docs, tiny)
    assert cut.columns == docs.columns and cut.count() == 6
    assert P.drop_contaminated(spark, docs, tiny).count() == 6
    out = P.encode(spark, docs, tiny).collect()
    assert len(out) == 6 and all(r["round_trip"] for r in out)
    assert P.keep_quality(spark, docs, tiny).columns == docs.columns
    assert P.keep_quality(spark, docs.limit(0), tiny).count() == 0
