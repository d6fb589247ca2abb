"""The search pipeline for a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.model import Corpus, SearchOptions
from quarry.operators.refine import diversify, expand, flagged, rerank, with_spans
from quarry.operators.retrieval import attach, fuse, picked, text_leg, vector_leg
from quarry.storage import at_hand, durable, hinted

HIT = ("query_id", "rank", "score", "chunk_id", "document_id", "path", "title", "topic", "date", "tags", "heading", "content", "match_spans", "expanded_from", "low_confidence")


#: Queries that are few: their legs are one plan, and their hits are fetched before content is read. Rows that are fetched so.
FEW, FEW_ROWS = 64, 4096


def _few(queries: DataFrame) -> tuple[DataFrame, int | None]:
    """The queries and their number, if they are few: then as a table that plans hold themselves."""
    held = at_hand(queries, FEW)
    return (held[0], held[1].num_rows) if held else (queries, None)


def _candidates(corpus: Corpus, queries: DataFrame, asked: int | None, options: SearchOptions) -> DataFrame:
    legs = []
    if "vector" in queries.columns:
        legs.append(vector_leg(corpus, queries.where("vector is not null"), options.filters, options.pool, asked))
    if "query" in queries.columns:
        legs.append(text_leg(corpus, queries.where("query is not null"), options.filters, options.fusion, options.pool, asked))
    fused = fuse(legs, options.fusion.k, None if options.mmr.enabled else options.fused)
    if asked is None or (found := at_hand(fused, FEW_ROWS)) is None:
        fused = durable(fused, "fused")
        few = hinted(fused)
        return attach(few, corpus if few is not fused else Corpus(corpus.documents, picked(corpus.chunks, fused), corpus.vectors))
    ids = found[1].column("chunk_id").unique().to_pylist()  # the scan of the chunks' texts skips row groups by them
    return attach(F.broadcast(found[0]), Corpus(corpus.documents, corpus.chunks.where(F.col("id").isin(ids)), corpus.vectors))


def candidates(corpus: Corpus, queries: DataFrame, options: SearchOptions) -> DataFrame:
    """Fused candidates with their columns; all of them where MMR follows, else as many as the next step takes."""
    return _candidates(corpus, *_few(queries), options)


def search(corpus: Corpus, queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
    """Hits of each row (query_id, query and / or vector), best first by rank from 0.

    Both legs cut by rank before they filter, reciprocal ranks fuse them, then reranking, MMR, the confidence flag (on scores before
    expansion), parent expansion and spans (on expanded content) follow as the options say.
    """
    options = options or SearchOptions()
    queries, asked = _few(queries)
    hits = _candidates(corpus, queries, asked, options)
    if options.rerank:
        hits = rerank(hits, queries, None if options.mmr.enabled else options.hits)
    hits = diversify(hits, corpus.vectors, options.hits, options.mmr) if options.mmr.enabled else hits.where(F.col("rank") < options.hits)
    if options.parent.enabled:
        hits = durable(hits, "hits")  # read twice; as many rows as queries times the limit at most
    hits = flagged(hits, options.min_confidence_ratio)
    if options.parent.enabled:
        hits = expand(hits, corpus.chunks, options.parent)
    else:
        hits = hits.withColumn("expanded_from", F.lit(None).cast("struct<kind:string,from_index:int,to_index:int,total_chunks:int>"))
    hits = with_spans(hits, queries) if "query" in queries.columns else hits.withColumn("match_spans", F.lit(None).cast("array<struct<start:int,end:int>>"))
    return hits.select(*HIT)
