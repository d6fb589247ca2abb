"""The stored index: segments of documents, chunks, vectors and postings that never change, and a manifest that says which of them are live.

A change writes one more segment with the documents that it brings and a table of the document revisions that it ends; the manifest of the
next number, put in place last, makes both visible at once. Whoever opened an earlier one keeps reading that snapshot. A document keeps its
id over all revisions; each revision has a serial, from which the ids of its chunks are made, so those of ended revisions never come again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import category_of, embedding_text, fold, topic_of
from quarry.model import Corpus, LazyCorpus, TextIndex, VectorCells
from quarry.operators.maintenance import actions, check_model, hashed_embedder, rename_pairs
from quarry.sources.cells import open_cells, write_cells
from quarry.sources.corpus import STRIDE as LINES
from quarry.sources.corpus import corpus
from quarry.sources.files import MOST_RULE_BYTES, chunk_rows, parsed, scan
from quarry.sources.postings import open_postings, write_postings
from quarry.storage import drop_tables, durable, hinted, numbered, shared_folder, written

FORMAT = 3
#: Chunk ids are a revision's serial times this, plus the chunk's index.
STRIDE = 1 << 20
#: Segments and ended revisions that a manifest may list; beyond that, or when half of the chunks are ended, the index is compacted.
MOST_SEGMENTS, MOST_DEAD = 8, 1_000_000
#: Paths of a batch of events that are looked up one by one; more are a scan of the folder.
MOST_PATHS = 1000
#: The file of ignore patterns at the top of a folder.
IGNORE_FILE = ".quarryignore"
_built: dict[tuple[str, str], tuple[tuple, Corpus]] = {}


def _spread(df: DataFrame, key: str) -> DataFrame:
    """df over as many partitions as tasks can run; a table of more partitions stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


def _file(spark: SparkSession, path: str):
    """(file system, path) of the JVM: what a manifest needs is a rename that fails where the name is taken."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the manifests under folder, oldest first."""
    fs, p = _file(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def meta_of(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """The latest manifest, or that of a version; empty where there is no index."""
    known = versions(spark, folder)
    if not known:
        return {}
    fs, p = _file(spark, f"{folder}/manifest-{version or known[-1]:010d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Puts a manifest in place, whole or not at all. One of this number being there means that another writer was first."""
    fs, part = _file(spark, f"{folder}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    _, to = _file(spark, f"{folder}/manifest-{manifest['version']:010d}.json")
    if fs.exists(to) or not fs.rename(part, to):
        fs.delete(part, False)
        raise RuntimeError(f"the index under {folder} was changed by another writer")


def _serial(chunk_id: str, stride: int) -> Column:
    return F.floor(F.col(chunk_id) / F.lit(stride)).cast("long")


def _length() -> Column:
    """A chunk's trigrams over all fields, as the text index counts them."""
    return reduce(lambda a, b: a + b, [F.greatest(F.length(fold(F.coalesce(c, F.lit("")))) - 2, F.lit(0)) for c in ("heading", "context_text", "content")]).cast("long")


def _write_segment(kb: Corpus, folder: str, number: int, buckets: int | None) -> dict:
    """Writes documents (with serials), chunks, vectors and postings as a segment; returns its entry."""
    spark = kb.documents.sparkSession
    name = f"segment-{number}-{uuid.uuid4().hex[:8]}"
    kb.documents.write.parquet(f"{folder}/{name}/documents")
    kb.chunks.write.parquet(f"{folder}/{name}/chunks")
    before = written(spark)
    write_cells(durable(kb.vectors, "vectors"), f"{folder}/{name}/vectors", number << 20)
    drop_tables(spark, [p for p in written(spark) if p not in before])
    return {"name": name, "number": number} | write_postings(spark.read.parquet(f"{folder}/{name}/chunks"), f"{folder}/{name}/postings", buckets, number)


def write_index(kb: Corpus, folder: str, meta: dict | None = None, stride: int = LINES) -> Corpus:
    """Makes the corpus the whole of the index under folder and returns it as stored. Its chunk ids are serial times stride plus index, where
    a document without a serial has its id for one. What the corpus is made of may be an earlier version of the same index."""
    spark = kb.documents.sparkSession
    number = (versions(spark, folder) or [0])[-1] + 1
    docs = kb.documents if "serial" in kb.documents.columns else kb.documents.withColumn("serial", F.col("id").cast("long"))
    segment = _write_segment(replace(kb, documents=docs), folder, number, None)
    top = spark.read.parquet(f"{folder}/{segment['name']}/documents").agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"), F.coalesce(F.max("serial"), F.lit(0)).alias("serial")).first()
    entry = {"segments": [segment], "dead": [], "dead_chunks": 0, "dead_length": 0, "stride": stride, "next_id": top["id"] + 1, "next_serial": top["serial"] + 1}
    _commit(spark, folder, {"format": FORMAT, "version": number} | entry | (meta or {}))
    return open_index(spark, folder)


def _dead(spark: SparkSession, folder: str, manifest: dict) -> np.ndarray:
    """The serials of ended revisions, at most MOST_DEAD."""
    if not manifest["dead"]:
        return np.zeros(0, np.int64)
    return spark.read.schema("serial long").parquet(*(f"{folder}/{d}" for d in manifest["dead"])).toArrow().column("serial").to_numpy()


def _tables(spark: SparkSession, folder: str, manifest: dict, dead: np.ndarray):
    """(name, serial) -> the live rows of that table of all segments."""
    gone = F.broadcast(spark.createDataFrame(pa.table({"serial": dead}))) if len(dead) else None

    def live(name: str, serial: Column) -> DataFrame:
        parts = [spark.read.parquet(f"{folder}/{s['name']}/{name}") for s in manifest["segments"]]
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        return rows if gone is None else rows.join(gone.withColumnRenamed("serial", "__gone"), serial == F.col("__gone"), "left_anti")

    return live


def open_index(spark: SparkSession, folder: str, version: int | None = None) -> Corpus:
    """The latest snapshot of the index under folder, or that of an earlier version."""
    manifest = meta_of(spark, folder, version)
    if manifest.get("format") != FORMAT:
        raise ValueError(f"{folder} holds no index of format {FORMAT}")
    dead, stride = _dead(spark, folder, manifest), manifest["stride"]
    live = _tables(spark, folder, manifest, dead)
    names = [f"{folder}/{s['name']}" for s in manifest["segments"]]
    cells = open_cells(spark, [f"{n}/vectors" for n in names])
    if len(dead):
        gone = F.broadcast(spark.createDataFrame(pa.table({"__gone": dead})))
        cells = replace(cells, rows=cells.rows.join(gone, _serial("chunk_id", stride) == F.col("__gone"), "left_anti"))
    stats = {"buckets": manifest["segments"][0]["buckets"]} | {k: sum(s[k] for s in manifest["segments"]) - manifest[f"dead_{k}"] for k in ("chunks", "length")}
    text = open_postings(spark, [f"{n}/postings" for n in names], stats, dead, stride)
    return Corpus(live("documents", F.col("serial")), live("chunks", _serial("id", stride)), cells.rows.select("chunk_id", "embedding"), text, cells)


def _text(spark: SparkSession, path: str) -> str:
    """The text of a small file, empty where there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isFile():
        return ""
    if fs.getFileStatus(p).getLen() > MOST_RULE_BYTES:
        raise ValueError(f"{path} has more than {MOST_RULE_BYTES} bytes")
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _present(spark: SparkSession, root: str, paths: list[str]) -> list[str]:
    return [p for p in paths if (f := _file(spark, f"{root}/{p}"))[0].exists(f[1]) and f[0].getFileStatus(f[1]).isFile()]


def rebuild(
    spark: SparkSession, root: str, folder: str, extensions: tuple[str, ...] = ("md",), folders: tuple[str, ...] | None = None, ignore: str = "",
    embed=hashed_embedder, model: str = "hashed-64", force: bool = False, only: list[str] | None = None, ignore_file: str = IGNORE_FILE,
) -> Corpus:
    """Brings the index under folder to the state of the files under root, and returns it. What was done is counted in meta_of()["counters"].

    Files are compared with the index by path and hash: a gone path whose hash comes up at a new one is a rename, other gone ones are deleted,
    those that could not be read or parsed are skipped and stay as they were. Only renamed, updated and added files are parsed; chunks whose
    text for the embedder is that of a chunk of the same document before keep its vector, only others are embedded. A run that finds nothing
    to do writes nothing. force ends all revisions and parses and embeds everything anew; another model than the index's needs it.
    only: paths that changed, as a stream of events tells them; all others are taken to be as they were, unless the rules changed.

    Rules are what says which files count: extensions, folders, ignore, and the patterns of the file ignore_file under root, which is read
    at each run. The index keeps their digest, so that the first run under other rules looks at the whole folder.
    """
    old = meta_of(spark, folder)
    ignore = "\n".join(x for x in (ignore, _text(spark, f"{root}/{ignore_file}")) if x)
    rules = hashlib.sha256(json.dumps([sorted(extensions), None if folders is None else sorted(folders), ignore]).encode()).hexdigest()
    only = only if old.get("rules") == rules else None
    if old and not force:
        check_model({"model": old.get("model", ""), "dim": ""}, model, "")
    fresh = not old or force
    manifest = {"segments": [], "dead": [], "dead_chunks": 0, "dead_length": 0, "stride": STRIDE, "next_id": old.get("next_id", 1), "next_serial": old.get("next_serial", 1)} if fresh else old
    few = only is not None and not fresh and len(only) <= MOST_PATHS
    found = _present(spark, root, only) if few else None
    files = scan(spark, root, extensions, folders, ignore, only=found)
    files = files if only is None or few else files.join(spark.createDataFrame([(p,) for p in only], "path string"), "path", "left_semi")
    disk = durable(files.select("path", "content_hash", "size_bytes", "status"), "disk")
    dead = _dead(spark, folder, old) if old else None
    live = _tables(spark, folder, old, dead) if old else None
    stored = live("documents", F.col("serial")).select("id", "serial", "path", "content_hash") if old else spark.createDataFrame([], "id long, serial long, path string, content_hash string")
    stored = stored if only is None or fresh else stored.join(F.broadcast(spark.createDataFrame([(p,) for p in only], "path string")), "path", "left_semi")
    pairs = rename_pairs(stored, disk) if not fresh else spark.createDataFrame([], "old string, new string")
    moved = durable(stored.join(pairs, stored["path"] == pairs["old"], "left").select("id", "serial", "content_hash", F.coalesce("new", "path").alias("path"), F.col("new").isNotNull().alias("renamed")), "stored")
    act = actions(moved, disk, force).join(moved.select("path", "id", "serial", "renamed"), "path", "left")
    act = durable(act.withColumn("action", F.when(F.col("renamed") & (F.col("action") == "unchanged"), "renamed").otherwise(F.col("action"))), "actions")
    todo = act.where(F.col("action").isin("renamed", "updated", "added"))
    meta = durable(parsed(files.where("status = 'ok'").join(hinted(todo.select("path")), "path", "left_semi"), extensions), "parsed")
    good = meta.where("error is null").select("path")
    known = todo.join(good, "path").select("path", "id", "serial", "action")
    numbers = numbered(known.select("path"), "path", "serial", manifest["next_serial"])
    ids = numbered(known.where("id is null").select("path"), "path", "new_id", manifest["next_id"])
    names = durable(known.withColumnRenamed("serial", "ended").join(numbers, "path").join(ids, "path", "left").select("path", F.coalesce("id", "new_id").alias("id"), "serial", "ended", "action"), "names")
    gone = durable(names.select(F.col("ended").alias("serial")).union(act.where("action = 'deleted'").select("serial")).union(todo.where("action = 'renamed'").join(good, "path", "left_anti").select("serial")).where("serial is not null"), "ended")
    n = {r["action"]: r["n"] for r in names.groupBy("action").agg(F.count("*").alias("n")).collect()}
    acts = {r["action"]: r["n"] for r in act.groupBy("action").agg(F.count("*").alias("n")).collect()}
    refused = meta.where("error is not null").count()
    counters = {"updated": n.get("updated", 0) + n.get("added", 0), "renamed": n.get("renamed", 0), "deleted": acts.get("deleted", 0), "skipped": acts.get("skipped", 0) + refused}
    ended = gone.count()
    if old and not fresh and not n and not ended:
        if old.get("rules") != rules:
            _commit(spark, folder, old | {"version": old["version"] + 1, "rules": rules})
        return open_index(spark, folder)
    meta_rows = meta.where("error is null").select("path", "title", "date", "depth", "tags", F.col("topic").alias("own_topic"))
    docs = names.join(disk.select("path", "content_hash", "size_bytes"), "path").join(meta_rows, "path")
    docs = docs.select("id", "serial", "path", "title", F.coalesce("own_topic", topic_of(F.col("path"))).alias("topic"), category_of(F.col("path")).alias("category"), "depth", "tags", "date", "content_hash", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_indexed"), "size_bytes")
    rows = chunk_rows(meta).join(names.select("path", "id", "serial"), "path")
    chunks = durable(rows.select((F.col("serial") * STRIDE + F.col("chunk_index")).alias("id"), F.col("id").alias("document_id"), "chunk_index", "heading", "level", "content", "token_count", "quality_score", "context_text"), "chunks")
    texts = chunks.select(F.col("id").alias("chunk_id"), "document_id", embedding_text(F.col("context_text"), F.col("content")).alias("text")).withColumn("said", F.sha2("text", 256))
    if old and not force:
        before = live("chunks", _serial("id", old["stride"])).join(hinted(names.where("ended is not null").select(F.col("ended").alias("__e"))), _serial("id", old["stride"]) == F.col("__e"), "left_semi")
        before = before.select(F.col("id").alias("chunk_id"), "document_id", F.sha2(embedding_text(F.col("context_text"), F.col("content")), 256).alias("said"))
        vectors = open_index(spark, folder).vectors
        kept = before.join(vectors, "chunk_id").groupBy("document_id", "said").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
        reused = durable(texts.join(kept, ["document_id", "said"]).select("chunk_id", "embedding"), "reused")
    else:
        reused = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    missing = durable(texts.join(reused, "chunk_id", "left_anti").select("chunk_id", "text"), "to-embed")
    new = durable(embed(missing).select("chunk_id", "embedding"), "embedded")
    number = old.get("version", 0) + 1
    buckets = manifest["segments"][0]["buckets"] if manifest["segments"] else None
    out = dict(manifest, format=FORMAT, version=number, model=model, rules=rules, segments=list(manifest["segments"]), dead=list(manifest["dead"]))
    if n or not out["segments"]:
        out["segments"].append(_write_segment(Corpus(docs, chunks, reused.unionByName(new)), folder, number, buckets))
        top = names.agg(F.max("id").alias("id"), F.max("serial").alias("serial")).first()
        out["next_id"], out["next_serial"] = max(out["next_id"], (top["id"] or 0) + 1), max(out["next_serial"], (top["serial"] or 0) + 1)
    if ended and not fresh:
        gone.distinct().repartition(1).write.parquet(f"{folder}/ended-{number}")  # a number for each ended revision
        out["dead"].append(f"ended-{number}")
        lost = live("chunks", _serial("id", old["stride"])).join(hinted(gone), _serial("id", old["stride"]) == F.col("serial"), "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum(_length()), F.lit(0)).alias("l")).first()
        out["dead_chunks"], out["dead_length"] = out["dead_chunks"] + lost["n"], out["dead_length"] + lost["l"]
    embedded = new.count()
    again = missing.select(_serial("chunk_id", STRIDE).alias("serial")).distinct()
    counters["embedded"] = embedded
    counters["meta_only"] = names.where("ended is not null").join(again, "serial", "left_anti").count()
    total = sum(s["chunks"] for s in out["segments"])
    counters["total_chunks"] = total - out["dead_chunks"]
    counters["total_documents"] = (0 if fresh else live("documents", F.col("serial")).count()) - (0 if fresh else gone.distinct().count()) + sum(n.values())
    _commit(spark, folder, out | {"counters": counters})
    dead_now = 0 if fresh else len(dead) + ended
    if len(out["segments"]) > MOST_SEGMENTS or dead_now > MOST_DEAD or 2 * out["dead_chunks"] > max(total, 1):
        return compact(spark, folder)
    return open_index(spark, folder)


def compact(spark: SparkSession, folder: str) -> Corpus:
    """The live rows of the index as one segment."""
    old = meta_of(spark, folder)
    kept = {k: old[k] for k in ("model", "rules", "counters", "next_id", "next_serial") if k in old}
    return write_index(open_index(spark, folder), folder, kept, old["stride"])


def drop_unused(spark: SparkSession, folder: str) -> list[str]:
    """Deletes what the latest manifest does not list, and the manifests before it. Nobody may read an earlier version any more."""
    manifest = meta_of(spark, folder)
    live = {f"manifest-{manifest['version']:010d}.json", *(s["name"] for s in manifest["segments"]), *manifest["dead"]}
    fs, p = _file(spark, folder)
    dropped = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().lstrip(".").startswith(("manifest-", "segment-", "ended-")) and s.getPath().getName() not in live]
    for path in dropped:
        fs.delete(path, True)
    return sorted(path.getName() for path in dropped)


def reset_for_model(spark: SparkSession, folder: str, new_folder: str, embed, model: str) -> Corpus:
    """The index under folder with all vectors made anew by another model, written to new_folder."""
    kb, old = open_index(spark, folder), meta_of(spark, folder)
    texts = kb.chunks.select(F.col("id").alias("chunk_id"), embedding_text(F.col("context_text"), F.col("content")).alias("text"))
    return write_index(replace(kb, vectors=embed(texts)), new_folder, {"model": model, "next_id": old["next_id"], "next_serial": old["next_serial"]}, old["stride"])


def stored(spark: SparkSession, sf_dir: str) -> Corpus:
    """The supplied tables with their stored index, of which each part is made for the first caller of an application that needs it; later ones
    open it. Documents and vectors are read where they are, chunks are stored once, postings and cells are made if a search looks few phrases
    or vectors up. Tables that changed since (by the time or size of their files) are taken anew."""
    key = (spark.sparkContext.applicationId, sf_dir)
    state = _state(spark, [f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet"])
    if key not in _built or _built[key][0] != state:
        folder = f"{shared_folder(spark)}/quarry-index-{uuid.uuid4().hex}"
        kb = corpus(spark, sf_dir)

        def chunks() -> DataFrame:
            corpus(spark, sf_dir, _spread).chunks.write.option("compression", "zstd").parquet(f"{folder}/chunks")
            return spark.read.schema(kb.chunks.schema).parquet(f"{folder}/chunks")

        def text() -> TextIndex:
            return open_postings(spark, [f"{folder}/postings"], write_postings(own.chunks, f"{folder}/postings"))

        def cells() -> VectorCells:
            write_cells(kb.vectors, f"{folder}/vectors")
            return open_cells(spark, [f"{folder}/vectors"])

        docs = kb.documents.withColumn("serial", F.col("id").cast("long"))
        own = LazyCorpus(documents=lambda: docs, chunks=chunks, vectors=lambda: kb.vectors, text=text, cells=cells)
        _built[key] = state, own
    return _built[key][1]


def _state(spark: SparkSession, paths: list[str]) -> tuple:
    """Length, number of files and latest time of each table's files."""
    out = []
    for path in paths:
        fs, p = _file(spark, path)
        summary = fs.getContentSummary(p)
        out.append((path, summary.getLength(), summary.getFileCount(), max([fs.getFileStatus(p).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(p))])))
    return tuple(out)
