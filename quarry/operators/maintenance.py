"""Index maintenance as set operations: what a scan of the disk means for a stored index, renames, deletions, upserts and repairs.

Tables are rewritten, not changed in place: each function returns the new table. A disk scan has path, content_hash, size_bytes and status (ok, or
skipped for files that could not be read, which are never deleted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import category_of, embedding_text, quality_score, topic_of
from quarry.model import Corpus
from quarry.storage import numbered


def rename_pairs(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """(old, new): gone and new paths of equal hash, paired one to one in path order."""
    gone = stored.join(disk.select("path"), "path", "left_anti").select(F.col("path").alias("old"), "content_hash")
    new = disk.where("status = 'ok'").join(stored.select("path"), "path", "left_anti").select(F.col("path").alias("new"), "content_hash")
    number = lambda c: F.row_number().over(Window.partitionBy("content_hash").orderBy(c))
    return gone.withColumn("n", number("old")).join(new.withColumn("n", number("new")), ["content_hash", "n"]).select("old", "new")


def rename(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    moved = documents.join(pairs, documents["path"] == pairs["old"], "left")
    return moved.withColumn("path", F.coalesce("new", "path")).select(*documents.columns)


def deletions(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Stored paths that the scan neither saw nor skipped."""
    return stored.select("path").join(disk.select("path"), "path", "left_anti")


def actions(stored: DataFrame, disk: DataFrame, force: bool = False) -> DataFrame:
    """(path, action): unchanged, updated, added, skipped or deleted for every path on either side."""
    s, d = stored.select("path", F.col("content_hash").alias("old")), disk.select("path", F.col("content_hash").alias("new"), "status")
    a = F.when(F.col("status").isNull(), "deleted").when(F.col("status") != "ok", "skipped").when(F.col("old").isNull(), "added")
    a = a.when((F.col("old") == F.col("new")) & ~F.lit(force), "unchanged").otherwise("updated")
    return s.join(d, "path", "full_outer").select("path", a.alias("action"))


def upsert(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows by path: known paths keep their id, new ones get the next ids in path order."""
    known = incoming.drop("id").join(documents.select("path", "id"), "path")
    new = incoming.drop("id").join(documents.select("path"), "path", "left_anti")
    top = documents.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    added = numbered(new, "path", "id", top + 1)
    kept = documents.join(incoming.select("path"), "path", "left_anti")
    return kept.unionByName(known, allowMissingColumns=True).unionByName(added, allowMissingColumns=True).select(*documents.columns)


def meta_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, same): whether a document's chunks (chunk_index, heading, content, context_text) are unchanged, so that vectors can be reused."""
    pack = lambda df, name: df.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", F.coalesce("heading", F.lit("\0")), "content", F.coalesce("context_text", F.lit("\0"))))).alias(name))
    return pack(old, "a").join(pack(new, "b"), "document_id").select("document_id", (F.to_json("a") == F.to_json("b")).alias("same"))


def delete_documents(corpus: Corpus, paths: DataFrame) -> Corpus:
    """The corpus without the documents of these paths, their chunks and vectors."""
    docs = corpus.documents.join(paths, "path", "left_anti")
    chunks = corpus.chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return Corpus(docs, chunks, corpus.vectors.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"))


def with_path_fields(documents: DataFrame) -> DataFrame:
    """category from the path; topic as given, else from the path."""
    return documents.withColumns({"category": category_of(F.col("path")), "topic": F.coalesce("topic", topic_of(F.col("path")))})


def backfill_quality(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("quality_score", F.when(F.col("quality_score") == 1.0, quality_score(F.col("content"))).otherwise(F.col("quality_score")))


def record_sizes(documents: DataFrame, disk: DataFrame) -> DataFrame:
    sizes = disk.select("path", F.col("size_bytes").alias("found"))
    return documents.join(sizes, "path", "left").withColumn("size_bytes", F.coalesce("size_bytes", "found")).select(*documents.columns)


def missing_vectors(corpus: Corpus) -> DataFrame:
    """(chunk_id, text) of chunks without a vector: what an embedder has to read."""
    chunks = corpus.chunks.withColumnRenamed("id", "chunk_id").join(corpus.vectors, "chunk_id", "left_anti")
    return chunks.select("chunk_id", embedding_text(F.col("context_text"), F.col("content")).alias("text"))


def hashed_embedder(rows: DataFrame, dim: int = 64) -> DataFrame:
    """(chunk_id, embedding): hashed trigrams, normalised; the deterministic stand-in for a model."""
    text = F.concat(F.lit("  "), F.lower("text"), F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(3))), F.lit(2 * dim)))
    counts = rows.select("chunk_id", F.explode(grams).alias("g")).groupBy("chunk_id", (F.col("g") % dim).alias("at")).agg(F.sum(F.when(F.col("g") < dim, 1.0).otherwise(-1.0)).alias("x"))
    packed = counts.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    values = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.greatest("norm", F.lit(1e-12))).cast("float"))
    return packed.select("chunk_id", values.alias("embedding"))


def check_model(meta: dict[str, str], model: str, dim: int) -> dict[str, str]:
    """The metadata to go on with: adopted where empty; another model or dimension is an error."""
    if not meta.get("model"):
        return meta | {"model": model, "dim": str(dim)}
    if meta["model"] != model or meta.get("dim") != str(dim):
        raise ValueError(f"the index was built with {meta['model']} of {meta.get('dim')} dimensions, not {model} of {dim}; rebuild with force")
    return meta


def context_mode(recorded: str | None, wanted: str, chunks: int, force: bool) -> tuple[str, str | None]:
    """(mode, warning): force and empty indexes take what is wanted, others stay as recorded, unrecorded ones off."""
    if force or chunks == 0:
        return wanted, None
    mode = recorded or "off"
    return mode, None if mode == wanted else f"the index keeps context mode {mode}; rebuild with force for {wanted}"
