"""The corpus pipeline: documents through five operators of quarry.llm, each stage on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and rereads it as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontaminate import mark_contaminated
from quarry.llm.durable import durable
from quarry.llm.lattice import Pieces, encode_samples
from quarry.llm.near_dedup import near_duplicates
from quarry.llm.quality import fit_quality, score_quality
from quarry.llm.registry import pieces_path
from quarry.llm.suffix_dedup import remove_repeats


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more. Fitted on labelled rows of docs."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8 or more: that of the smallest id.

    Rows that repeat an id are one document and stay or go together; rows without an id stay.
    """
    gone = near_duplicates(docs, n=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of strings of 100 bytes that also start earlier; n_chars counts what is left."""
    out = remove_repeats(docs)
    return out.select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to 0.8 or more."""
    return mark_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, as token ids with their scores."""
    return encode_samples(docs, Pieces.from_model(pieces_path(spark)), k=2, ids=True, group=1 << 18)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("lattice_encoding", encode),
]
#: SQL can't express a fitted model, sketches or sampled segmentations; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
