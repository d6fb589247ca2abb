"""Columns of the input that bear the names of results, or names with dots."""

from quarry.llm import suffix_dedup
from quarry.llm.quality import RuleEnsemble, score_quality
from quarry.llm.sharding import assign_shards
from quarry.llm.suffix_dedup import remove_repeats

LONG = "The same long passage stands in both of the texts, word for word, so that a hundred bytes of it and more are met again. "


def test_shard_by_a_replaced_column(spark):
    rows = spark.createDataFrame([(k, "x", k + 5) for k in range(20)], "slot long, shard string, doc_id long")
    got = {r["doc_id"]: (r["slot"], r["shard"]) for r in assign_shards(rows, key_col="slot").collect()}
    want = {r["k"] + 5: (r["slot"], r["shard"]) for r in assign_shards(rows.selectExpr("slot as k"), key_col="k").collect()}
    assert got == want


def test_score_by_replaced_columns(spark):
    model = RuleEnsemble(0.5, ())
    rows = [(k, f"Text {k}.", 1.0) for k in range(12)]
    plain = {r["id"]: r["held_out"] for r in score_quality(spark.createDataFrame(rows, "id long, text string, x double"), model, id_col="id").collect()}
    got = score_quality(spark.createDataFrame(rows, "score long, predicted string, `a.b` double"), model, id_col="score", text_col="predicted").collect()
    assert got[0].asDict().keys() == {"a.b", "held_out", "score", "predicted"} and sorted(r["held_out"] for r in got) == sorted(plain.values())


def test_repeats_with_dots_and_result_names(spark):
    rows = [(1, LONG + "one", "u", -1, -2), (2, LONG + "two", "v", -1, -2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, n_removed int, kept_sha256 int")
    got = {r["doc_id"]: r for r in remove_repeats(frame).collect()}
    assert got[2]["text"] == "two" and got[2]["a.b"] == "v" and got[2]["n_removed"] == len(LONG) and len(got[2]["kept_sha256"]) == 64 and got[1]["n_removed"] == 0
    assert list(got[1].asDict()) == ["doc_id", "text", "a.b", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert remove_repeats(frame.limit(0)).count() == 0
    named = frame.toDF("n_bytes", "my.text", "x", "y", "z")
    assert {r["n_bytes"]: r["n_removed"] for r in remove_repeats(named, id_col="n_bytes", text_col="my.text").collect()} == {1: 0, 2: len(LONG)}


def test_buckets_follow_the_texts(spark):
    rows = spark.createDataFrame([(k, LONG) for k in range(4)], "id long, text string")
    assert suffix_dedup._buckets(rows, rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))
