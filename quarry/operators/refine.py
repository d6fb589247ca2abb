"""What follows fusion: reranking, MMR diversification, parent expansion, match spans and the confidence flag."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quarry.functions.spans import match_spans
from quarry.functions.vectors import cosine_matrix
from quarry.model import Mmr, Parent
from quarry.storage import hinted


def lexical_overlap(query: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the query's words that a text holds; the deterministic stand-in for a cross-encoder."""
    out = []
    for q, t in zip(query, text, strict=True):
        words = set((q or "").lower().split())
        out.append(len(words & set((t or "").lower().split())) / len(words) if words else 0.0)
    return pd.Series(out, dtype="float64")


def rerank(hits: DataFrame, queries: DataFrame, limit: int | None, scorer=lexical_overlap) -> DataFrame:
    """Scores replaced by scorer(query, context + blank line + content), best first, cut at the limit."""
    text = F.when(F.coalesce(F.trim("context_text"), F.lit("")) != "", F.concat_ws("\n\n", "context_text", "content")).otherwise(F.col("content"))
    score = pandas_udf(scorer, "double")
    rows = hits.drop("score", "rank").join(hinted(queries.select("query_id", "query")), "query_id").withColumn("score", score("query", text)).drop("query")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")) - 1)
    return rows if limit is None else rows.where(F.col("rank") < limit)


def relevance(hits: DataFrame) -> DataFrame:
    """Adds relevance: scores scaled to 0..1 within a query; all 0 where they hardly differ."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("relevance", F.when(high - low > 1.1920929e-07, (F.col("score") - low) / (high - low)).otherwise(0.0))


def select_diverse(x: np.ndarray, relevance: np.ndarray, documents: np.ndarray, limit: int, lam: float, penalty: float) -> list[int]:
    """Greedy choice by lam * relevance - (1 - lam) * (largest cosine with the chosen) - penalty if the document is chosen; ties to the lower index."""
    sims, out = cosine_matrix(x), []
    nearest, seen, left = np.zeros(len(x)), np.zeros(len(x), bool), np.ones(len(x), bool)
    while len(out) < min(limit, len(x)):
        value = np.where(left, lam * relevance - (1 - lam) * nearest - penalty * seen, -np.inf)
        best = int(np.argmax(value))
        nearest = sims[best].copy() if not out else np.maximum(nearest, sims[best])
        seen |= documents == documents[best]
        left[best] = False
        out.append(best)
    return out


def diversify(hits: DataFrame, vectors: DataFrame, limit: int, mmr: Mmr) -> DataFrame:
    """Up to limit hits a query in order of choice (rank from 0), with their own scores. Hits without a vector are dropped."""
    lam, penalty = mmr.lam, mmr.same_document_penalty

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "chunk_id"]).reset_index(drop=True)
        picked = select_diverse(np.array(rows["embedding"].tolist(), np.float64), rows["relevance"].to_numpy(), rows["document_id"].to_numpy(), limit, lam, penalty)
        return pd.DataFrame({"query_id": key[0], "chunk_id": rows["chunk_id"].to_numpy()[picked], "rank": np.arange(len(picked))})

    pool = relevance(hits).select("query_id", "chunk_id", "document_id", "rank", "relevance").join(vectors, "chunk_id")
    chosen = pool.groupBy("query_id").applyInPandas(choose, "query_id long, chunk_id long, rank int")
    return hits.drop("rank").join(chosen, ["query_id", "chunk_id"])


def expand(hits: DataFrame, chunks: DataFrame, parent: Parent) -> DataFrame:
    """Content widened to the whole document for small chunks of small documents, else to the neighbours; expanded_from says how.

    A chunk under whole_document_below tokens takes its document unless that has 2 * max + 64 chunks or more, or more than max tokens.
    Otherwise chunks index - 1 to index + 1 are joined by blank lines; over max tokens the hit stays alone. Quality and level don't matter.
    """
    tokens = F.when(F.coalesce("token_count", F.lit(0)) > 0, F.col("token_count")).otherwise(F.floor(F.octet_length("content") / 4))
    own = hits.select("query_id", "chunk_id", "document_id", F.col("chunk_index").alias("at"), F.coalesce(F.col("token_count") < parent.whole_document_below, F.lit(False)).alias("small"))
    rows = chunks.select("document_id", "chunk_index", F.col("content").alias("text"), tokens.cast("long").alias("tokens"))
    # of a document at most 2 * max + 64 chunks are read, those of the least indexes, and the hit's neighbours
    near = F.abs(F.col("chunk_index") - F.col("at")) <= 1
    bound = 2 * parent.max_tokens + 64
    documents = own.select("document_id").distinct()
    first = rows.join(documents, "document_id", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")))
    met = own.join(first, "document_id").where(near | (F.col("small") & (F.col("r") <= bound))).drop("r")
    part = F.struct("chunk_index", "text")
    found = met.groupBy("query_id", "chunk_id", "at", "small").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("total"), F.sum(F.when(near, F.col("tokens"))).alias("near_total"),
        F.sort_array(F.collect_list(F.when(near, part))).alias("near"), F.sort_array(F.collect_list(part)).alias("all"),
    )
    whole = F.col("small") & (F.col("n") < 2 * parent.max_tokens + 64) & (F.col("total") <= parent.max_tokens)
    fits = F.col("near_total") <= parent.max_tokens
    text = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "\n\n")
    first, last = F.array_min(F.transform("near", lambda x: x["chunk_index"])), F.array_max(F.transform("near", lambda x: x["chunk_index"]))
    null = F.lit(None).cast("int")
    origin = F.when(whole, F.struct(F.lit("whole_document").alias("kind"), null.alias("from_index"), null.alias("to_index"), F.col("n").cast("int").alias("total_chunks")))
    origin = origin.otherwise(F.struct(F.lit("adjacent").alias("kind"), F.when(fits, first).otherwise(F.col("at")).alias("from_index"), F.when(fits, last).otherwise(F.col("at")).alias("to_index"), null.alias("total_chunks")))
    wide = found.select("query_id", "chunk_id", F.when(whole, text("all")).when(fits, text("near")).alias("wide"), origin.alias("expanded_from"))
    return hits.join(wide, ["query_id", "chunk_id"]).withColumn("content", F.coalesce("wide", "content")).drop("wide")


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _spans(query: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([None if (s := match_spans(q, c)) is None else [{"start": a, "end": b} for a, b in s] for q, c in zip(query, content, strict=True)])


def with_spans(hits: DataFrame, queries: DataFrame) -> DataFrame:
    return hits.join(hinted(queries.select("query_id", "query")), "query_id").withColumn("match_spans", pandas_udf(_spans, _SPANS)("query", "content")).drop("query")


def low_confidence(hits: DataFrame, ratio: float = 1.5) -> DataFrame:
    """(query_id, low_confidence): two hits or more whose best score is under ratio times the mean."""
    s = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.avg("score").alias("mean"))
    return s.select("query_id", ((F.col("n") >= 2) & F.lit(ratio != 0) & (F.col("mean") > 0) & (F.col("top") / F.col("mean") < ratio)).alias("low_confidence"))


def flagged(hits: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Adds low_confidence() of its query to each hit, in one pass over the hits."""
    w = Window.partitionBy("query_id")
    n, top, mean = F.count(F.lit(1)).over(w), F.max("score").over(w), F.avg("score").over(w)
    return hits.withColumn("low_confidence", (n >= 2) & F.lit(ratio != 0) & (mean > 0) & (top / mean < ratio))
