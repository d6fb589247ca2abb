"""The stored text index: for each trigram and block of chunks the places where it stands, as a Parquet table parted by trigram buckets.

Chunks are dealt into blocks. Within a block each chunk's three folded fields lie one after another, parted by a gap that no trigram crosses,
so a place is one number and a phrase stands where its trigrams' places, each less its offset, agree. A row for a trigram holds its places as
differences, and the block's largest number of occurrences in a field and least chunk length: no chunk of the block can score more than these
allow. A row without trigram, in bucket -1, lists the block's chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import fold
from quarry.model import TextIndex
from quarry.storage import plain_unions

#: Characters and chunks of a block; a longer chunk is a block of its own.
BLOCK_CHARS, BLOCK_CHUNKS = 1 << 20, 8192
#: Places between two fields, so that no three characters reach over.
GAP = 3
#: The bucket of the rows that list a block's chunks; characters of text for each bucket, and the limits of their number; characters of a written file.
HEADS, BUCKET_CHARS, BUCKETS, FILE_CHARS = -1, 1 << 20, (16, 4096), 1 << 28
SCHEMA = "bucket int, block long, gram string, places int, chunks int, most array<int>, least long, coords binary, ids array<long>, starts binary, lengths binary"


def bucket_of(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode()) % buckets


def packed(coords: np.ndarray) -> bytes:
    """Ascending places as their differences: the width in bytes, then the bytes of all differences place by place."""
    steps = np.diff(coords, prepend=0).astype("<u4")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    wide = np.zeros((planes.shape[1], 4), np.uint8)
    wide[:, : raw[0]] = planes.T
    return np.cumsum(wide.view("<u4").ravel(), dtype=np.int64)


def block_rows(block: int, ids: list[int], fields: list[tuple[str | None, ...]], buckets: int) -> pa.RecordBatch:
    """The rows of one block."""
    texts = [t or "" for three in fields for t in three]
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + GAP) - (size + GAP)
    length = np.maximum(size - 2, 0).reshape(-1, 3).sum(1)
    points = np.frombuffer(("\0" * GAP).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    field = np.repeat(np.arange(len(texts)), size + GAP)
    at = np.flatnonzero(np.arange(len(points)) + 3 <= (start + size)[field])
    key = (points[at] << 42) | (points[at + 1] << 21) | points[at + 2] if len(at) else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    number = np.repeat(np.arange(len(head)), np.diff(head, append=len(key)))
    own = field[at]
    run = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))  # a run for each trigram and field of a chunk
    most = np.zeros((len(head), 3), np.int32)
    np.maximum.at(most, (number[run], own[run] % 3), np.diff(run, append=len(key)))
    chunk = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(own // 3, prepend=-1) != 0))
    chunks = np.bincount(number[chunk], minlength=len(head))
    least = np.minimum.reduceat(length[own // 3], head) if len(head) else np.zeros(0, np.int64)
    grams = [chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in key[head].tolist()]
    coords = [packed(c) for c in np.split(at, head[1:])] if len(head) else []
    none = [None] * len(grams)
    columns = (
        pa.array([HEADS, *(bucket_of(g, buckets) for g in grams)], pa.int32()),
        pa.array([block] * (len(grams) + 1), pa.int64()),
        pa.array(["", *grams], pa.string()),
        pa.array([len(key), *np.diff(head, append=len(key)).tolist()], pa.int32()),
        pa.array([len(ids), *chunks.tolist()], pa.int32()),
        pa.array([[], *most.tolist()], pa.list_(pa.int32())),
        pa.array([int(length.sum()), *least.tolist()], pa.int64()),  # of the whole block: the length of all its chunks
        pa.array([None, *coords], pa.binary()),
        pa.array([ids, *none], pa.list_(pa.int64())),
        pa.array([start.astype("<i8").tobytes(), *none], pa.binary()),
        pa.array([length.astype("<i8").tobytes(), *none], pa.binary()),
    )
    return pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in SCHEMA.split(", ")])


def _indexer(buckets: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first + (TaskContext.get().partitionId() << 20)
        ids, fields, chars = [], [], 0
        for batch in batches:
            for chunk_id, *three in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = sum(len(t or "") for t in three)
                if ids and (chars + size > BLOCK_CHARS or len(ids) == BLOCK_CHUNKS):
                    yield block_rows(block, ids, fields, buckets)
                    block, ids, fields, chars = block + 1, [], [], 0
                ids.append(chunk_id)
                fields.append(tuple(three))
                chars += size
        if ids:
            yield block_rows(block, ids, fields, buckets)

    return run


def buckets_for(chars: int) -> int:
    """A power of two that grows with the text, within BUCKETS."""
    low, high = BUCKETS
    return min(high, max(low, 1 << max(0, (chars // BUCKET_CHARS).bit_length())))


def write_postings(chunks: DataFrame, folder: str, buckets: int | None = None, segment: int = 0) -> dict:
    """Writes the text index of chunks under folder; returns what open_postings() needs. Blocks of a segment have numbers of their own.

    Each task indexes the chunks it reads, block by block; rows are dealt by bucket, and large buckets into several files, sorted by trigram.
    """
    chars = chunks.agg(F.coalesce(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in ("heading", "context_text", "content"))), F.lit(0)).alias("n")).first()["n"]
    buckets = buckets or buckets_for(chars)
    rows = chunks.select("id", *(fold(F.col(c)).alias(c) for c in ("heading", "context_text", "content"))).mapInArrow(_indexer(buckets, segment << 40), SCHEMA)
    parts = max(1, -(-chars // (buckets * FILE_CHARS)))
    dealt = rows.repartition("bucket") if parts == 1 else rows.repartition(min(buckets * parts, 100_000), "bucket", F.pmod("block", F.lit(parts)))
    dealt.sortWithinPartitions("bucket", "gram", "block").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)
    total = chunks.sparkSession.read.schema(SCHEMA).parquet(folder).where(F.col("bucket") == HEADS).agg(F.sum("chunks").alias("chunks"), F.sum("least").alias("length")).first()
    return {"buckets": buckets, "chunks": total["chunks"] or 0, "length": total["length"] or 0}


def open_postings(spark: SparkSession, folders: list[str], stats: dict, dead: np.ndarray | None = None, stride: int = 1) -> TextIndex:
    """The text index under all folders, together. dead: what chunk ids of ended revisions give when divided by stride."""
    plain_unions(spark)
    rows = reduce(DataFrame.unionByName, [spark.read.schema(SCHEMA).parquet(f) for f in folders])
    return TextIndex(rows, stats["buckets"], stats["chunks"], stats["length"], np.zeros(0, np.int64) if dead is None else dead, stride)


def indexed_chunks(text: TextIndex) -> DataFrame:
    """(chunk_id) of all live chunks that the text index lists."""
    rows = text.rows.where(F.col("bucket") == HEADS).select(F.explode("ids").alias("chunk_id"))
    if not len(text.dead):
        return rows
    gone = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"gone": text.dead})))  # bounded by the index
    return rows.join(gone, F.floor(F.col("chunk_id") / text.stride) == F.col("gone"), "left_anti")
