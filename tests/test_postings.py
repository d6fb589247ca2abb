"""The stored text index against a scan of the chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.text import fold_text
from quarry.operators import checks, phrases, retrieval
from quarry.model import Corpus
from quarry.sources import postings

CHUNKS = "id long, document_id long, chunk_index int, heading string, level int, content string, token_count int, quality_score double, context_text string"


def test_places_survive_packing():
    r = np.random.default_rng(1)
    for high in (200, 60_000, 1 << 30):
        at = np.unique(r.integers(0, high, 300))
        assert (postings.unpacked(postings.packed(at)) == at).all()


def test_block_rows_by_hand():
    rows = postings.block_rows(7, [10, 11], [("abab", None, "xabab"), (None, "", "ab")], 4).to_pylist()
    head, *grams = rows
    assert head["ids"] == [10, 11] and head["bucket"] == postings.HEADS and head["least"] == 2 + 3
    by = {r["gram"]: r for r in grams}
    assert set(by) == {"aba", "bab", "xab"} and by["aba"]["most"] == [1, 0, 1] and by["aba"]["chunks"] == 1
    assert postings.unpacked(by["aba"]["coords"]).tolist() == [0, 4 + 3 + 3 + 1] and by["xab"]["bucket"] == postings.bucket_of("xab", 4)
    assert postings.block_rows(0, [1], [(None, "", "ab")], 4).num_rows == 1


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    words = ["river", "Rivers", "mill", "aaaa", "aaaaaa", "Été", "日本語の本", "x", "no"]
    text = lambda n: " ".join(r.choice(words, n))
    rows = [(k, k // 3, k % 3, text(2) if k % 2 else None, 2, text(int(r.integers(0, 9))), 1, 1.0, text(3) if k % 5 else None) for k in range(400)]
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(3)
    folder = str(tmp_path_factory.mktemp("postings"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(postings, "BLOCK_CHUNKS", 50)
        stats = postings.write_postings(chunks, folder)
    return chunks, postings.open_postings(spark, [folder], stats)


QUERIES = ["river", "river mill", "aaaa", '"no aaaa" mill', "été", "日本語", "nowhere here", "", "x", "rivers aaaaaa no"]


def table(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")


@pytest.mark.parametrize("k", [5, None])
def test_scores_equal_a_scan(spark, kb, k):
    chunks, text = kb
    weights = retrieval.weight_table(spark, (2.0, 1.0, 1.0), (1.0, 0.0, 4.0))
    got, want = (sorted(tuple(r) for r in retrieval.bm25(chunks, table(spark), weights, k, t).withColumn("bm25", F.round("bm25", 9)).collect()) for t in (text, None))
    assert got == want and len(got) > 20


def test_counts_equal_a_scan(spark, kb):
    chunks, text = kb
    got, want = (sorted(tuple(r) for r in retrieval.match_counts(chunks, table(spark), t).collect()) for t in (text, None))
    assert got == want and text.chunks == 400
    assert text.length == sum(max(len(fold_text(x or "")) - 2, 0) for r in chunks.collect() for x in (r["heading"], r["context_text"], r["content"]))


def test_only_the_phrases_buckets_are_read(kb):
    _, text = kb
    plan = phrases.needed(text, ["mill"])._jdf.queryExecution().toString()
    wanted = {postings.HEADS, *(postings.bucket_of(g, text.buckets) for g in ("mil", "ill"))}
    scan = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert all(str(b) in scan for b in wanted) and len(wanted) < text.buckets and "PushedFilters: [In(gram" in plan


def test_blocks_that_are_beaten_are_passed_over(kb):
    best = retrieval._Best(np.array([1.0]), 10.0, [(1, [0])], [(0, 1.0, 1.0, 1.0)], 1)
    assert not best.beaten({0: (np.array([1, 0, 0]), 10)})
    list(best.add(np.array([5]), np.array([10]), np.array([[0, 0, 9, 0, 0]])))
    assert best.beaten({0: (np.array([1, 0, 0]), 10)}) and not best.beaten({0: (np.array([9, 0, 0]), 10)}) and not best.beaten({0: (np.array([90, 0, 0]), 10)})


def test_doctor_reads_the_text_index(spark, kb):
    chunks, text = kb
    docs = spark.createDataFrame([(d, f"a/{d}.md", 1) for d in range(134)], "id long, path string, size_bytes long")
    vectors = chunks.select(F.col("id").alias("chunk_id"))
    rows = {r["check"]: r["n"] for r in checks.doctor(Corpus(docs, chunks.where("id <> 3"), vectors), postings.indexed_chunks(text).where("chunk_id not in (5, 6)")).collect()}
    assert rows["missing-text-row"] == 2 and rows["orphan-text-row"] == 1


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], CHUNKS)
    text = postings.open_postings(spark, [str(tmp_path / "p")], postings.write_postings(none, str(tmp_path / "p")))
    assert text.chunks == 0 and retrieval.bm25(none, table(spark), retrieval.weight_table(spark, (1, 1, 1)), 5, text).count() == 0
