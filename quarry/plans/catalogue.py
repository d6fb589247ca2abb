"""The engine's queries over the supplied tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import category_of, token_estimate, topic_of
from quarry.model import Corpus, Filters, Fusion, GraphOptions, Mmr, Parent, SearchOptions
from quarry.operators import checks, evaluation, graph, maintenance, predicates, refine, retrieval, sections, tuning
from quarry.plans.search import candidates, search
from quarry.sources.corpus import CORPUS_SQL
from quarry.sources.index import stored as corpus
from quarry.sources.files import chunk_rows, parsed
from quarry.sources.postings import indexed_chunks
from quarry.storage import durable
from quarry.streaming.maintain import batch_state, debounced

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _with(body: str, more: str = "") -> str:
    return f"WITH {CORPUS_SQL}{', ' + more if more else ''}\n{body}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector asks for its neighbours."""
    return _table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


#: Words that a document's query is made of: the first two runs of letters.
_WORD, _WORDS = "[A-Za-z]{4,24}", 2


def every_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document asks for its first words; a document without words asks for nothing."""
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD), F.lit(0)), 1, _WORDS)
    return _table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.lower(F.array_join(words, " ")).alias("query"))


def every_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector and document of one id ask together; where one is missing, the other asks alone."""
    rows = every_text_query(spark, sf_dir).join(vector_queries(spark, sf_dir), "query_id", "full")
    return rows.select("query_id", F.coalesce("query", F.lit("")).alias("query"), "vector")


def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, expected): every query expects the document of its id."""
    paths = corpus(spark, sf_dir).documents.select(F.col("id").alias("query_id"), F.array(F.struct("path", F.lit(None).cast("string").alias("heading"))).alias("expected"))
    none = F.array().cast("array<struct<path:string,heading:string>>")
    return every_query(spark, sf_dir).join(paths, "query_id", "left").withColumn("expected", F.coalesce("expected", none))


# --- nearest neighbours

KNN_SQL = """qv AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0
), near AS (SELECT query_id, chunk_id, sqrt(list_sum(list_transform(list_zip(embedding, vector), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS distance FROM kb_vectors CROSS JOIN qv
), knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1 AS rank FROM near)"""


@register(_with("SELECT query_id, chunk_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM knn WHERE rank < 10", KNN_SQL))
def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = corpus(spark, sf_dir)
    out = retrieval.knn(kb.vectors, vector_queries(spark, sf_dir), 10, kb.cells)
    return out.withColumn("distance", F.round("distance", 6))


@register(_with("SELECT query_id, chunk_id, round(least(greatest(1 - distance * distance / 2, 0), 1), 6) AS cosine FROM knn WHERE rank < 5", KNN_SQL))
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.functions.vectors import cosine_from_distance

    kb = corpus(spark, sf_dir)
    out = retrieval.knn(kb.vectors, vector_queries(spark, sf_dir), 5, kb.cells)
    return out.select("query_id", "chunk_id", F.round(cosine_from_distance(F.col("distance")), 6).alias("cosine"))


@register()
def knn_cells_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the vector queries reads of the stored cells for its ten nearest."""
    kb = corpus(spark, sf_dir)
    return retrieval.cells_read(kb.cells, kb.vectors, vector_queries(spark, sf_dir), 10)


_JOINED = "JOIN kb_chunks c ON c.id = k.chunk_id JOIN kb_documents d ON d.id = c.document_id"


@register(_with(f"SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS INTEGER) AS rank FROM (SELECT k.* FROM knn k {_JOINED} WHERE k.rank < 100 AND d.topic = 'en' AND c.quality_score >= 0.3) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10", KNN_SQL))
def knn_overfetch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_leg(corpus(spark, sf_dir), vector_queries(spark, sf_dir), Filters(topic="en"), 10).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


@register(_with(f"SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1 AS INTEGER) AS rank FROM (SELECT k.* FROM near k {_JOINED} WHERE d.topic = 'en' AND c.quality_score >= 0.3) QUALIFY rank < 10", KNN_SQL))
def knn_exact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = corpus(spark, sf_dir)
    rows = retrieval.attach(kb.vectors, kb).where(predicates.predicate(Filters(topic="en")))
    return retrieval.knn(rows.select("chunk_id", "embedding"), vector_queries(spark, sf_dir), 10).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


# --- full text


#: The terms of every_text_query().
EVERY_TERMS_SQL = f"""terms(query_id, p) AS (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{_WORD}')[1:{_WORDS}], lambda w: lower(w))) FROM documents WHERE doc_id % 50 = 0
)"""


def _bm25_sql(weights: tuple[float, float, float]) -> str:
    # words of any kind may overlap themselves, which replace() does not count
    occ = lambda c: f"CASE WHEN contains({c}, p) THEN len(list_filter(range(1, CAST(len({c}) - len(p) + 2 AS BIGINT)), lambda i: substr({c}, i, len(p)) = p)) ELSE 0 END"
    h, x, c = weights
    return f"""{EVERY_TERMS_SQL}, folded AS (SELECT id, strip_accents(lower(coalesce(heading, ''))) AS h, strip_accents(lower(context_text)) AS x, strip_accents(lower(content)) AS t,
  greatest(len(coalesce(heading, '')) - 2, 0) + greatest(len(context_text) - 2, 0) + greatest(len(content) - 2, 0) AS d FROM kb_chunks
), stats AS (SELECT count(*) AS n, avg(d) AS mean FROM folded
), occ AS (SELECT query_id, p, id, d, {occ("h")} AS oh, {occ("x")} AS ox, {occ("t")} AS ot FROM folded CROSS JOIN terms
), hit AS (SELECT *, {h} * oh + {x} * ox + {c} * ot AS tf, count(*) OVER (PARTITION BY query_id, p) AS df FROM occ WHERE oh + ox + ot > 0
), scored AS (SELECT query_id, id AS chunk_id, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / mean))) AS bm25 FROM hit CROSS JOIN stats GROUP BY 1, 2
), text_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), chunk_id) - 1 AS rank FROM scored)"""


BM25_SQL = _bm25_sql(Fusion().weights)


@register(_with("SELECT query_id, chunk_id, round(bm25, 6) AS bm25, CAST(rank AS INTEGER) AS rank FROM text_rank WHERE rank < 50", BM25_SQL))
def bm25_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = corpus(spark, sf_dir)
    out = retrieval.bm25(kb.chunks, every_text_query(spark, sf_dir), retrieval.weight_table(spark, Fusion().weights), 50, kb.text)
    return out.select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), "rank")


@register(_with("SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM text_rank WHERE rank < 50", _bm25_sql((0.5, 4.0, 1.0))))
def bm25_other_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = corpus(spark, sf_dir)
    out = retrieval.bm25(kb.chunks, every_text_query(spark, sf_dir), retrieval.weight_table(spark, (0.5, 4.0, 1.0)), 50, kb.text)
    return out.select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


@register(_with("SELECT query_id, count(DISTINCT id) AS matches FROM hit GROUP BY 1", BM25_SQL))
def fts_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = corpus(spark, sf_dir)
    return retrieval.match_counts(kb.chunks, every_text_query(spark, sf_dir), kb.text)


# --- fusion and the pipeline


def _hybrid_sql(where: str, fetch: int, fetch_vectors: int, pool: int) -> str:
    return f"""{BM25_SQL}, qv AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0
), near AS (SELECT query_id, chunk_id, sqrt(list_sum(list_transform(list_zip(embedding, vector), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS distance FROM kb_vectors CROSS JOIN qv
), knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1 AS rank FROM near
), a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM (SELECT k.* FROM knn k {_JOINED} WHERE k.rank < {fetch_vectors} AND {where}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {pool}
), b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM (SELECT k.* FROM text_rank k {_JOINED} WHERE k.rank < {fetch} AND {where}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {pool}
), fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2
), hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS INTEGER) AS rank FROM fused)"""


_DEFAULT_HYBRID = _hybrid_sql("c.quality_score >= 0.3", 500, 500, 50)


def _short(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@register(_with("SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits WHERE rank < 10", _DEFAULT_HYBRID))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(search(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=10)))


@register(_with("SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits WHERE rank < 5", _hybrid_sql("c.quality_score >= 0.3 AND d.topic = 'en' AND list_contains(d.tags, 'b1') AND d.date >= '2024-02-01'", 500, 500, 50)))
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Filters(topic="en", tags_all=("en", "b1"), date_from="2024-02-01")
    return _short(search(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=5, filters=f)))


@register(_with("SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits", _DEFAULT_HYBRID))
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(candidates(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=10, mmr=Mmr(enabled=True))))


@register(_with("SELECT query_id, chunk_id, round(CASE WHEN max(score) OVER w - min(score) OVER w > 1.1920929e-07 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 4) AS relevance FROM hits WINDOW w AS (PARTITION BY query_id)", _DEFAULT_HYBRID))
def minmax_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = candidates(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=10, mmr=Mmr(enabled=True)))
    return refine.relevance(hits).select("query_id", "chunk_id", F.round("relevance", 4).alias("relevance"))


@register(_with("SELECT query_id, count(*) >= 2 AND avg(score) > 0 AND max(score) / avg(score) < 1.5 AS low_confidence FROM hits WHERE rank < 10 GROUP BY 1", _DEFAULT_HYBRID))
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=10)).select("query_id", "low_confidence").distinct()


@register()
def mmr_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(search(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=10, mmr=Mmr(enabled=True, same_document_penalty=0.1))))


@register()
def reranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(search(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=10, rerank=True)))


_PARENT = Parent(enabled=True, whole_document_below=20, max_tokens=400)
PARENT_SQL = _DEFAULT_HYBRID + """, h AS (SELECT hits.query_id, hits.chunk_id, c.document_id, c.chunk_index AS at, c.token_count < 20 AS small, c.content FROM hits JOIN kb_chunks c ON c.id = hits.chunk_id WHERE rank < 10
), met AS (SELECT h.query_id, h.chunk_id, h.at, h.small, h.content AS own, c.chunk_index AS i, c.content, CASE WHEN c.token_count > 0 THEN c.token_count ELSE floor(strlen(c.content) / 4) END AS tokens, abs(c.chunk_index - h.at) <= 1 AS near
  FROM h JOIN kb_chunks c ON c.document_id = h.document_id WHERE h.small OR abs(c.chunk_index - h.at) <= 1
), wide AS (SELECT query_id, chunk_id, any_value(own) AS own, bool_or(small) AND count(*) < 864 AND sum(tokens) <= 400 AS whole, sum(tokens) FILTER (near) <= 400 AS fits,
  string_agg(content, chr(10) || chr(10) ORDER BY i) AS full_text, string_agg(content, chr(10) || chr(10) ORDER BY i) FILTER (near) AS near_text FROM met GROUP BY 1, 2)"""


@register(_with("SELECT query_id, chunk_id, CASE WHEN whole THEN full_text WHEN fits THEN near_text ELSE own END AS content, CASE WHEN whole THEN 'whole_document' ELSE 'adjacent' END AS kind FROM wide", PARENT_SQL))
def parent_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=10, parent=_PARENT)).select("query_id", "chunk_id", "content", F.col("expanded_from.kind").alias("kind"))


@register()
def match_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=20)).select("query_id", "chunk_id", "match_spans")


# --- chunks, documents, filters


@register(_with("SELECT id, chunk_index, heading, context_text, token_count, round(quality_score, 6) AS quality_score FROM kb_chunks"))
def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).chunks.select("id", "chunk_index", "heading", "context_text", "token_count", "quality_score")


@register(_with("SELECT quality_score >= 0.3 AS good, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM kb_chunks GROUP BY 1"))
def quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).chunks
    return c.groupBy((F.col("quality_score") >= 0.3).alias("good")).agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


@register("SELECT doc_id, CAST(floor(strlen(text) / 4) AS INTEGER) AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@register(_with("SELECT category, topic, count(*) AS documents FROM kb_documents GROUP BY 1, 2"))
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.topics(corpus(spark, sf_dir).documents).select("category", "topic", "documents")


@register(_with("SELECT category, topic, title FROM kb_documents"))
def topic_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.topic_titles(corpus(spark, sf_dir).documents)


@register(_with("SELECT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS prefix, count(*) AS documents FROM kb_documents GROUP BY 1"))
def topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.topic_groups(corpus(spark, sf_dir).documents)


@register(_with("SELECT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS prefix, path FROM kb_documents"))
def group_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.group_paths(corpus(spark, sf_dir).documents)


@register(_with("SELECT id, string_split(path, '/')[1] AS category, string_split(path, '/')[2] AS topic FROM kb_documents"))
def path_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).documents.select("id", category_of(F.col("path")).alias("category"), topic_of(F.col("path")).alias("topic"))


def _filter_query(f: Filters) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kb = corpus(spark, sf_dir)
        rows = retrieval.attach(kb.chunks.select(F.col("id").alias("chunk_id")), kb)
        return rows.where(predicates.predicate(f)).groupBy("document_id").agg(F.count("*").alias("chunks"))

    return run


for _name, _filters, _where in (
    ("filter_tags", Filters(tags_any=("b1", "b2"), tags_all=("en",)), "list_has_any(tags, ['b1', 'b2']) AND list_contains(tags, 'en') AND c.quality_score >= 0.3"),
    ("filter_dates", Filters(date_from="2024-03-01", date_to="2024-03-31", include_low_quality=True), "date BETWEEN '2024-03-01' AND '2024-03-31'"),
    ("filter_globs", Filters(path_globs=("src1*/**", "!*/de/*"), include_low_quality=True), "path LIKE 'src1%/%' AND path NOT LIKE '%/de/%'"),
    ("filter_quality", Filters(min_quality=0.7, category="src0"), "c.quality_score >= 0.7 AND category = 'src0'"),
):
    _QUERIES[_name] = _filter_query(_filters)
    _SQL[_name] = _with(f"SELECT c.document_id, count(*) AS chunks FROM kb_chunks c JOIN kb_documents d ON d.id = c.document_id WHERE {_where} GROUP BY 1")


# --- integrity


def _broken(spark: SparkSession, sf_dir: str) -> Corpus:
    kb = corpus(spark, sf_dir)
    return Corpus(kb.documents.where("id % 7 <> 0"), kb.chunks.where("document_id % 11 <> 0"), kb.vectors)


BROKEN_SQL = "d AS (SELECT * FROM kb_documents WHERE id % 7 <> 0), c AS (SELECT * FROM kb_chunks WHERE document_id % 11 <> 0), v AS (SELECT * FROM kb_vectors)"


@register(
    _with(
        """SELECT 'missing-embedding' AS "check", count(*) AS n FROM c WHERE id NOT IN (SELECT chunk_id FROM v)
        UNION ALL SELECT 'orphan-embedding', count(*) FROM v WHERE chunk_id NOT IN (SELECT id FROM c)
        UNION ALL SELECT 'chunk-without-document', count(*) FROM c WHERE document_id NOT IN (SELECT id FROM d)
        UNION ALL SELECT 'document-without-chunks', count(*) FROM d WHERE id NOT IN (SELECT document_id FROM c)
        UNION ALL SELECT 'missing-text-row', count(*) FROM c WHERE id % 13 = 0
        UNION ALL SELECT 'orphan-text-row', count(*) FROM kb_chunks WHERE id % 13 <> 0 AND document_id % 11 = 0
        UNION ALL SELECT 'extension-not-registered', 0 UNION ALL SELECT 'size-not-recorded', 0
        UNION ALL SELECT 'larger-than-a-read-returns', count(*) FROM d WHERE size_bytes > 1048576""",
        BROKEN_SQL,
    )
)
def doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an index that lost some documents, chunks and rows of its text index."""
    listed = indexed_chunks(corpus(spark, sf_dir).text).where("chunk_id % 13 <> 0")
    return checks.doctor(_broken(spark, sf_dir), listed).select("check", "n")


@register(_with("SELECT (SELECT count(*) FROM kb_documents) AS documents, CAST(0 AS BIGINT) AS without_size, count(*) AS chunks, count(*) AS with_context, count(*) FILTER (quality_score >= 0.3) AS good, count(*) FILTER (quality_score < 0.3) AS poor FROM kb_chunks"))
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.status(corpus(spark, sf_dir))


RULES = (checks.FieldRule("title", required=True, max_length=13), checks.FieldRule("topic", enum=("en", "fr", "de")), checks.FieldRule("date", pattern=r"^2024-0[1-9]"), checks.FieldRule("tags", min_length=1, enum=("en", "fr", "de", "es", "b0", "b1", "b2", "b3")), checks.FieldRule("depth", required=True))


@register(
    _with(
        """SELECT path, 'title' AS field, 'length' AS kind FROM kb_documents WHERE len(title) > 13
        UNION ALL SELECT path, 'topic', 'enum' FROM kb_documents WHERE topic NOT IN ('en', 'fr', 'de')
        UNION ALL SELECT path, 'date', 'pattern' FROM kb_documents WHERE NOT regexp_matches(date, '^2024-0[1-9]')
        UNION ALL SELECT path, 'tags', 'enum' FROM kb_documents WHERE list_contains(tags, 'b4')
        UNION ALL SELECT path, 'depth', 'missing' FROM kb_documents"""
    )
)
def frontmatter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.validate(corpus(spark, sf_dir).documents, RULES).select("path", "field", "kind")


# --- maintenance


def _disk(documents: DataFrame) -> DataFrame:
    """A later state of the folder: a third of the files moved, some changed, some gone, some unreadable."""
    moved = F.when(F.col("id") % 3 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    digest = F.when(F.col("id") % 5 == 0, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash"))
    status = F.when(F.col("id") % 13 == 0, "unreadable").otherwise("ok")
    return documents.where("id % 8 <> 0").select(moved.alias("path"), digest.alias("content_hash"), "size_bytes", status.alias("status"))


DISK_SQL = """disk AS (SELECT CASE WHEN id % 3 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN id % 5 = 0 THEN sha256(content_hash || 'x') ELSE content_hash END AS content_hash,
  CASE WHEN id % 13 = 0 THEN 'unreadable' ELSE 'ok' END AS status FROM kb_documents WHERE id % 8 <> 0)"""


@register(
    _with(
        "SELECT old, new FROM a JOIN b USING (content_hash, n)",
        DISK_SQL
        + """, a AS (SELECT path AS old, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM kb_documents WHERE path NOT IN (SELECT path FROM disk)
), b AS (SELECT path AS new, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM disk WHERE status = 'ok' AND path NOT IN (SELECT path FROM kb_documents))""",
    )
)
def rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).documents
    return maintenance.rename_pairs(docs, _disk(docs))


@register(_with("SELECT path FROM kb_documents WHERE path NOT IN (SELECT path FROM disk)", DISK_SQL))
def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).documents
    return maintenance.deletions(docs, _disk(docs))


@register(
    _with(
        """SELECT coalesce(s.path, d.path) AS path, CASE WHEN d.status IS NULL THEN 'deleted' WHEN d.status <> 'ok' THEN 'skipped' WHEN s.path IS NULL THEN 'added'
        WHEN s.content_hash = d.content_hash THEN 'unchanged' ELSE 'updated' END AS action FROM kb_documents s FULL JOIN disk d ON s.path = d.path""",
        DISK_SQL,
    )
)
def index_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).documents
    return maintenance.actions(docs, _disk(docs))


@register(
    _with(
        """SELECT id, path, content_hash FROM kb_documents WHERE path NOT IN (SELECT path FROM disk) UNION ALL SELECT s.id, d.path, d.content_hash FROM disk d JOIN kb_documents s USING (path)
        UNION ALL SELECT CAST((SELECT max(id) FROM kb_documents) + row_number() OVER (ORDER BY path) AS BIGINT), path, content_hash FROM disk WHERE path NOT IN (SELECT path FROM kb_documents)""",
        DISK_SQL,
    )
)
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).documents
    incoming = _disk(docs).select(F.lit(None).cast("long").alias("id"), "path", "content_hash", "size_bytes")
    return maintenance.upsert(docs, incoming).select("id", "path", "content_hash")


@register("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@register(_with("SELECT id AS chunk_id, sha256(context_text || chr(10) || chr(10) || content) AS digest FROM kb_chunks WHERE id NOT IN (SELECT chunk_id FROM kb_vectors)"))
def texts_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.missing_vectors(corpus(spark, sf_dir)).select("chunk_id", F.sha2("text", 256).alias("digest"))


@register()
def parsed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the Markdown parser, with a heading before each third line."""
    raw = _table(spark, sf_dir, "documents").where("doc_id is not null")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## Section "), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    files = raw.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode(F.array_join(lines, "\n"), "utf-8").alias("content"))
    return chunk_rows(parsed(files)).select("path", "chunk_index", "heading", "level", "context_text", "token_count")


#: Lines with a heading of level 1 to 4 before every third one.
HEADED_SQL = """lines AS (SELECT doc_id AS document_id, CAST(unnest(range(2 * len(l))) AS INTEGER) AS pos, unnest(flatten([[CASE WHEN i % 3 = 0 THEN repeat('#', CAST(1 + (i // 3 * 7 + doc_id) % 4 AS INTEGER)) || ' Part ' || i END, l[i + 1]] FOR i IN range(len(l))])) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL)
), leveled AS (SELECT *, CASE WHEN pos % 2 = 0 AND line IS NOT NULL THEN len(regexp_extract(line, '^#+')) END AS level, CASE WHEN pos % 2 = 0 THEN regexp_replace(line, '^#+ ', '') END AS heading FROM lines
), placed AS (SELECT document_id, pos, level, count(level) OVER w AS section FROM leveled WINDOW w AS (PARTITION BY document_id ORDER BY pos)
), above AS (SELECT a.document_id, a.section, max(a.level) AS level, list(h.heading ORDER BY h.pos) FILTER (h.heading IS NOT NULL) AS ancestors
  FROM (SELECT document_id, section, pos, level FROM placed WHERE level IS NOT NULL) a
  LEFT JOIN LATERAL (SELECT l.heading, l.pos FROM leveled l WHERE l.document_id = a.document_id AND l.pos < a.pos AND l.level < a.level
    AND NOT EXISTS (SELECT 1 FROM leveled m WHERE m.document_id = l.document_id AND m.pos > l.pos AND m.pos < a.pos AND m.level <= l.level)) h ON true GROUP BY 1, 2)"""


@register(
    _with(
        """SELECT document_id, CAST(section AS BIGINT) AS section, level, coalesce(array_to_string(ancestors, ' > '), '') AS ancestors FROM above""",
        HEADED_SQL,
    )
)
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of every document, with a heading of level 1 to 4 set before each third line."""
    raw = _table(spark, sf_dir, "documents").where("doc_id is not null")
    mark = lambda i: F.concat(F.repeat(F.lit("#"), (1 + (F.floor(i / 3) * 7 + F.col("doc_id")) % 4).cast("int")), F.lit(" Part "), i.cast("string"))
    lines = F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.array(F.when(i % 3 == 0, mark(i)), x)))
    rows = raw.select(F.col("doc_id").alias("document_id"), F.posexplode(lines).alias("pos", "line"))
    found = sections.sections(rows).where("level is not null")
    return found.select("document_id", "section", F.col("level").cast("long").alias("level"), F.array_join("ancestors", " > ").alias("ancestors"))


# --- evaluation

#: Every query expects one document, which counts once.
METRICS_SQL = _DEFAULT_HYBRID + f""", asked AS (SELECT doc_id AS query_id FROM documents WHERE doc_id % 50 = 0
), j AS (SELECT asked.query_id, min(rank) + 1 AS r FROM asked LEFT JOIN (SELECT query_id, rank, chunk_id // 1000000 AS document_id FROM hits WHERE rank < 10) h ON h.query_id = asked.query_id AND h.document_id = asked.query_id GROUP BY 1
), ks(k) AS (VALUES (1), (5), (10)
), m AS (SELECT query_id, 'recall' AS metric, k, CASE WHEN r <= k THEN 1.0 ELSE 0.0 END AS value FROM j CROSS JOIN ks
  UNION ALL SELECT query_id, 'rr', 0, coalesce(1.0 / r, 0) FROM j
  UNION ALL SELECT query_id, 'ndcg', k, CASE WHEN r <= k THEN 1 / log2(r + 1) ELSE 0 END FROM j CROSS JOIN ks)"""
_RUN = SearchOptions(limit=10)


def _evaluated(spark: SparkSession, sf_dir: str) -> evaluation.Run:
    return evaluation.evaluate(corpus(spark, sf_dir), golden_set(spark, sf_dir), _RUN, (1, 5, 10))


@register(_with("SELECT query_id, metric, CAST(k AS INTEGER) AS k, round(value, 6) AS value FROM m", METRICS_SQL))
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).metrics.withColumn("value", F.round("value", 6))


@register(_with("SELECT metric, CAST(k AS INTEGER) AS k, round(avg(value), 6) AS value, count(*) AS queries FROM m GROUP BY 1, 2", METRICS_SQL))
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).aggregate.withColumn("value", F.round("value", 6))


@register(_with("SELECT metric, CAST(k AS INTEGER) AS k FROM (SELECT DISTINCT metric, k FROM m) WHERE k = 5", METRICS_SQL))
def eval_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a run whose values at k = 5 were a tenth higher."""
    now = _evaluated(spark, sf_dir).aggregate
    before = now.withColumn("value", F.when(F.col("k") == 5, F.col("value") + 0.1).otherwise(F.col("value")))
    return evaluation.regressions(now, before).select("metric", "k")


QUOTES_SQL = r"""needles AS (SELECT n, min(item_id) AS id FROM (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE length(n) >= 12 GROUP BY n
), hay AS (SELECT document_id, lower(trim(regexp_replace(unnest([heading, context_text, content]), '\s+', ' ', 'g'))) AS h FROM kb_chunks
), found AS (SELECT DISTINCT document_id, n, id FROM hay JOIN needles ON contains(h, n)
), live AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.document_id = f.document_id AND g.n <> f.n AND contains(g.n, f.n)))"""


@register(_with("SELECT d.path, count(*) AS needles, array_to_string(list_sort(list(live.id)), '|') AS queries FROM live JOIN kb_documents d ON d.id = live.document_id GROUP BY 1", QUOTES_SQL))
def golden_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that quote a benchmark item word for word, had none been expected."""
    items = _table(spark, sf_dir, "benchmark").where("item_id is not null and text is not null").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    unexpected = items.withColumn("expected", F.array().cast("array<struct<path:string,heading:string>>"))
    found = evaluation.quoted_queries(corpus(spark, sf_dir), unexpected, least=1)
    return found.select("path", "needles", F.array_join(F.transform("queries", lambda q: q.cast("string")), "|").alias("queries"))


SNAPSHOT_SQL = """parts AS (SELECT sha256(list_aggregate([CASE WHEN v IS NULL THEN 'n' ELSE 's' || strlen(v) || ':' || v END FOR v IN [d.path, CAST(c.chunk_index AS VARCHAR), c.heading, c.content, c.context_text]], 'string_agg', '')) AS s
  FROM kb_chunks c JOIN kb_documents d ON d.id = c.document_id
), total AS (SELECT count(*) AS chunks, sum(CAST('0x' || s[1:15] AS HUGEINT)) AS one, sum(CAST('0x' || s[16:30] AS HUGEINT)) AS two FROM parts)"""


@register(_with("SELECT (SELECT count(*) FROM kb_documents) AS documents, chunks, sha256(one || '|' || two) AS content FROM total", SNAPSHOT_SQL))
def corpus_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.corpus_snapshot(corpus(spark, sf_dir))


# --- before and after a sweep

_ASKED_SQL = "everyone AS (SELECT doc_id AS query_id FROM documents WHERE doc_id % 50 = 0 UNION SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)"
PREFLIGHT_SQL = _DEFAULT_HYBRID + f""", {_ASKED_SQL}
, mc AS (SELECT query_id, count(DISTINCT id) AS m FROM hit GROUP BY 1), tc AS (SELECT query_id, count(*) AS t FROM b GROUP BY 1), vc AS (SELECT query_id, count(*) AS v FROM a GROUP BY 1
), oc AS (SELECT query_id, count(*) AS o FROM a JOIN b USING (query_id, chunk_id) GROUP BY 1)"""


@register(
    _with(
        """SELECT query_id, coalesce(m, 0) AS matches, 2 * coalesce(m, 0) >= n AS idf_clamped, coalesce(t, 0) AS text_candidates, coalesce(v, 0) AS vector_candidates, coalesce(o, 0) AS overlap, coalesce(t, 0) >= 2 AS effective
        FROM everyone LEFT JOIN mc USING (query_id) LEFT JOIN tc USING (query_id) LEFT JOIN vc USING (query_id) LEFT JOIN oc USING (query_id) CROSS JOIN stats""",
        PREFLIGHT_SQL,
    )
)
def tune_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.preflight(corpus(spark, sf_dir), every_query(spark, sf_dir))


@register(_with("SELECT query_id, count(*) FILTER (tie) AS ties FROM (SELECT query_id, coalesce(score = lag(score) OVER (PARTITION BY query_id ORDER BY rank), false) AS tie FROM hits WHERE rank < 10) GROUP BY 1", _DEFAULT_HYBRID))
def tune_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.adjacent_ties(candidates(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=10)))


def _ranked_by(name: str, weights: tuple[float, float, float]) -> str:
    """The text candidates under other weights, as a table of this name."""
    tail = _bm25_sql(weights).split("), hit AS (", 1)[1].replace("hit ", f"hit_{name} ").replace("scored AS", f"scored_{name} AS").replace("FROM scored", f"FROM scored_{name}").replace("text_rank AS", f"rank_{name} AS")
    return f", hit_{name} AS ({tail}, {name} AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM (SELECT k.* FROM rank_{name} k {_JOINED} WHERE k.rank < 500 AND c.quality_score >= 0.3) QUALIFY r <= 50)"


@register(_with("SELECT doc_id AS query_id, EXISTS (SELECT 1 FROM heavy_h x FULL JOIN heavy_c y ON x.query_id = y.query_id AND x.r = y.r WHERE coalesce(x.query_id, y.query_id) = doc_id AND x.chunk_id IS DISTINCT FROM y.chunk_id) AS sensitive FROM documents WHERE doc_id % 50 = 0", BM25_SQL + _ranked_by("heavy_h", tuning.EXTREMES[0]) + _ranked_by("heavy_c", tuning.EXTREMES[1])))
def tune_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.sensitivity(corpus(spark, sf_dir), every_text_query(spark, sf_dir))


# --- graph, sweep, stream


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document."""
    return corpus(spark, sf_dir).documents.where("id % 50 = 0").select(F.col("id").alias("start_id"), "path")


@register()
def connection_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = graph.connection_graphs(corpus(spark, sf_dir), _starts(spark, sf_dir), GraphOptions(min_similarity=0.2))
    return nodes.withColumn("score", F.round("score", 6))


#: A document of the model has one vector, that of its first line, so a walk has one seed.
GRAPH_SQL = KNN_SQL + f""", seed AS (SELECT d.id AS start_id, c.id AS chunk_id FROM kb_documents d JOIN kb_chunks c ON c.document_id = d.id JOIN kb_vectors v ON v.chunk_id = c.id WHERE d.id % 50 = 0
), met AS (SELECT start_id, k.chunk_id, k.rank, least(greatest(1 - distance * distance / 2, 0), 1) AS score FROM seed JOIN knn k ON k.query_id = seed.start_id JOIN kb_chunks c ON c.id = k.chunk_id WHERE k.rank < 10 AND c.document_id <> start_id
), reached AS (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY rank) AS id FROM met WHERE score >= 0.2)"""


@register(
    _with(
        """SELECT start_id, CAST(0 AS INTEGER) AS id, CAST(NULL AS INTEGER) AS parent_id, CAST(0 AS INTEGER) AS depth, 1.0::DOUBLE AS score, chunk_id FROM seed
        UNION ALL SELECT start_id, CAST(id AS INTEGER), 0, 1, round(score, 6), chunk_id FROM reached WHERE id <= 5""",
        GRAPH_SQL,
    )
)
def graph_first_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = graph.connection_graphs(corpus(spark, sf_dir), _starts(spark, sf_dir), GraphOptions(depth=1, min_similarity=0.2))
    return nodes.select("start_id", "id", "parent_id", "depth", F.round("score", 6).alias("score"), "chunk_id")


@register(
    _with(
        """SELECT start_id, 1 + count(reached.chunk_id) FILTER (id <= 5) AS total_nodes, CAST(1 AS BIGINT) AS knn_queries, CAST(1 AS BIGINT) AS seeds_used, false AS max_seed_chunks, false AS max_nodes FROM seed LEFT JOIN reached USING (start_id) GROUP BY 1""",
        GRAPH_SQL,
    )
)
def graph_centroid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the walks from the documents' centroids asked and used; of one seed the centroid has its direction."""
    _, stats = graph.connection_graphs(corpus(spark, sf_dir), _starts(spark, sf_dir), GraphOptions(depth=1, min_similarity=0.2, strategy="centroid"))
    return stats


def _sweep_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_set(spark, sf_dir).drop("vector")


@register()
def sweep_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb, g = corpus(spark, sf_dir), _sweep_golden(spark, sf_dir)
    return tuning.sweep_metrics(kb, every_query(spark, sf_dir), g, Filters(), 10, (1, 5, 10)).withColumn("value", F.round("value", 6))


@register()
def tune_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sweep's choice is adopted, with all folds."""
    kb, g = corpus(spark, sf_dir), _sweep_golden(spark, sf_dir)
    return tuning.decide_by_folds(durable(tuning.sweep_metrics(kb, every_query(spark, sf_dir), g, Filters(), 10, (1, 5, 10)), "metrics"))


@register("WITH live AS (SELECT user_id, ts, event_id, event_type FROM events WHERE user_id IS NOT NULL), last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM live) SELECT user_id || '.md' AS path, event_id FROM last WHERE n = 1 AND event_type <> 'purchase'")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that replaying events as file events leads to: a purchase deindexes, all others reindex."""
    events = _table(spark, sf_dir, "events").where("user_id is not null")
    kind = F.when(F.col("event_type") == "purchase", "deindex").otherwise("reindex")
    files = events.select("event_id", "ts", kind.alias("kind"), F.concat(F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("new_path"))
    return batch_state(files).select("path", "event_id")


@register(
    """WITH e AS (SELECT user_id || '.md' AS path, ts FROM events WHERE user_id IS NOT NULL), f AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS head FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)
), g AS (SELECT *, sum(head) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT path, min(ts) AS "first", max(ts) AS "last", count(*) AS events FROM g GROUP BY path, s"""
)
def debounced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").where("user_id is not null")
    return debounced(events.select(F.concat(F.col("user_id").cast("string"), F.lit(".md")).alias("path"), "ts"), "1 hour")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(corpus(spark, sf_dir), every_query(spark, sf_dir), SearchOptions(limit=10))


@register(_with("SELECT 'documents' AS \"table\", count(*) AS n FROM kb_documents UNION ALL SELECT 'chunks', count(*) FROM kb_chunks UNION ALL SELECT 'vectors', count(*) FROM kb_vectors WHERE chunk_id IS NOT NULL AND embedding IS NOT NULL"))
def index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stored index."""
    kb = corpus(spark, sf_dir)
    parts = [t.select(F.lit(n).alias("table")).groupBy("table").count().withColumnRenamed("count", "n") for n, t in (("documents", kb.documents), ("chunks", kb.chunks), ("vectors", kb.vectors))]
    return parts[0].union(parts[1]).union(parts[2])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
