"""Removal of byte strings that occur earlier, exactly, by suffixes that start at content-chosen anchors.

A byte is removed if it lies in a window of `window` bytes that also starts earlier in the corpus.

1. Each window has an anchor that depends on its bytes alone (quarry.llm.anchors), so equal windows lie alike around equal
   anchors. Consecutive windows with one anchor form a run; one row for each run goes on, with a 96-bit hash of all its bytes.
   Batches are taken together up to a number of runs, and runs that equal an earlier one among them are removed on the spot:
   a passage in a third of all texts leaves one row for each such part of the input.
2. Runs meet by a hash of their anchor. All runs but the first of a class are removed whole. Firsts whose anchor stands in
   runs with other bytes are open: some of their windows may have occurred before.
3. Open runs fetch their bytes and are cut into slices by the windows' distance from the anchor; a slice's windows have a core in common,
   and slices meet by the core's hash. The windows of a group are suffix-sorted by hash comparison (quarry.llm.suffix_sort);
   neighbours with a common extension of `window` bytes are verified byte by byte. Runs of anchors that are very frequent in some batch
   meet by single windows, which are pre-aggregated in the batch, so that no group gets a row from each of many texts.
4. A text's spans are joined and cut from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.anchors import anchor_runs
from quarry.llm.durable import as_id, durable, release_memory, small_batches
from quarry.llm.hashing import U64, Polynomial, joined, splitmix
from quarry.llm.suffix_sort import Suffixes

WINDOW = 100
GRAM = 36
#: Slices of open runs, by the distance from window start to anchor.
SLICE = 33
#: An anchor with more different runs than this in one batch is met by single windows everywhere.
FREQUENT = 48
#: Batches are settled together until they have so many runs, as about 17 MB of text have.
GATHERED = 1 << 19
#: Compressed input bytes for each bucket of runs, about a million runs.
BUCKET_BYTES = 16 << 20

_RUN = np.dtype([("key", "u8"), ("check", "u4"), ("anchor", "u4"), ("pos", "i4"), ("doc", "u4"), ("count", "u1"), ("lead", "u1"), ("hot", "u1")])
_OPEN = np.dtype([("pos", "i8"), ("count", "i4"), ("lead", "i4"), ("hot", "i4")])


def _mark(text: bytes) -> int:
    """Tells apart texts that repeat an id."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(array.tobytes(), 1)


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the union of intervals; touching ones are joined."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(head)
    return np.stack([start[at], end[np.append(at[1:], len(start)) - 1]], 1) if len(start) else np.zeros((0, 2), np.int64)


def _rows(kind: int, doc_id: np.ndarray, mark: np.ndarray, doc: np.ndarray, items: np.ndarray) -> pa.RecordBatch | None:
    """A row (kind, id, mark, blob) for each document; items: (start, end) pairs to unite (kind 1) or _OPEN rows (kind 2)."""
    if not len(items):
        return None
    order = np.argsort(doc, kind="stable")
    doc, items = doc[order], items[order]
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    parts = np.split(items, at[1:])
    blobs = [(_merged(p[:, 0], p[:, 1]) if kind == 1 else p).tobytes() for p in parts]
    own = doc[at]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(doc_id[own]), pa.array(mark[own]), pa.array(blobs, pa.binary())], names=["kind", "id", "mark", "blob"])


_FOUND = "kind int, id long, mark long, blob binary"


def _utf8(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _streamed(column: pa.Array, marks: list[int]) -> Iterator[bytes]:
    """The texts of a column, of which only a few are held at a time; marks gets their marks."""
    for low in range(0, len(column), 64):
        for text in _utf8(column.slice(low, 64)):
            marks.append(_mark(text))
            yield text


def _batch_runs(column: pa.Array, one: Polynomial, two: Polynomial) -> tuple[np.ndarray, np.ndarray]:
    """(_RUN rows of all texts, the texts' marks)."""
    parts, marks = [np.zeros(0, _RUN)], []
    for first, _last, data, offsets in joined(_streamed(column, marks)):
        prefix, other = one.prefix(data), two.prefix(data)
        r = anchor_runs(prefix, offsets, one, WINDOW, GRAM)
        out = np.zeros(len(r.start), _RUN)
        end = r.last + WINDOW
        lead = r.anchor - r.start
        out["key"] = splitmix(one.spans(prefix, r.start, end) ^ (lead * 256 + end - r.start).astype(U64))
        out["check"] = splitmix(two.spans(other, r.start, end)) >> U64(32)
        out["anchor"] = splitmix(two.spans(other, r.anchor, r.anchor + GRAM)) >> U64(32)
        out["pos"], out["doc"] = r.start - offsets[r.text], r.text + first
        out["count"], out["lead"] = r.last - r.start + 1, lead
        parts.append(out)
    return np.concatenate(parts), np.array(marks, np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(_RUN rows, ids, marks) of consecutive batches that come to GATHERED runs; their texts are not held."""
    one, two = Polynomial(0), Polynomial(1)
    parts, ids, marks, rows, size = [], [], [], 0, 0
    for batch in batches:
        runs, mark = _batch_runs(batch.column(1), one, two)
        runs["doc"] += np.uint32(rows)
        parts.append(runs)
        ids.append(np.array(batch.column(0).to_numpy(zero_copy_only=False)))
        marks.append(mark)
        rows, size = rows + batch.num_rows, size + len(runs)
        del batch, runs
        if size >= GATHERED:
            whole = np.concatenate(parts), np.concatenate(ids), np.concatenate(marks)
            parts, ids, marks, rows, size = [], [], [], 0, 0
            yield whole
            del whole
    if size:
        yield np.concatenate(parts), np.concatenate(ids), np.concatenate(marks)


def _settled(runs: np.ndarray, ids: np.ndarray, mark: np.ndarray, buckets: int) -> tuple[list[tuple[int, bytes]], pa.RecordBatch | None]:
    """Of a batch's runs: ((bucket, blob) of those that go on, rows of the spans that are known). Its working arrays end with the call."""
    later, class_of = _later(runs, ids)
    gone = runs[later]
    rows = _rows(1, ids, mark, gone["doc"].astype(np.int64), np.stack([gone["pos"].astype(np.int64), gone["pos"].astype(np.int64) + gone["count"] - 1 + WINDOW], 1))
    del gone
    runs, class_of = runs[~later], class_of[~later]
    # different runs of an anchor, numbered
    order = np.lexsort((class_of, runs["anchor"]))
    a = runs["anchor"][order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.append(start, len(a)))
    number = np.empty(len(a), np.int64)
    number[order] = np.arange(len(a)) - np.repeat(start, size)
    hot = np.empty(len(a), bool)
    hot[order] = np.repeat(size > FREQUENT, size)
    runs["hot"] = hot
    bucket = (runs["anchor"] % np.uint32(buckets)).astype(np.int64)
    salted = hot & (number >= 2)
    bucket[salted] = (splitmix(runs["key"][salted]) % U64(buckets)).astype(np.int64)
    del later, class_of, a, start, size, number, hot, salted
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
    blobs = []
    for part in np.split(order, at[1:]):
        own = runs[part]
        docs, own["doc"] = np.unique(own["doc"], return_inverse=True)
        blobs.append((int(bucket[part[0]]), _blob(own, ids[docs], mark[docs])))
    return blobs, rows


def _find_runs(buckets: int):
    """Rows (bucket, kind, id, mark, blob): kind 0 has the runs of a few batches for one bucket, kind 1 spans that are already known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, ids, mark in _gathered(batches):
            blobs, rows = _settled(runs, ids, mark, buckets)
            n = len(blobs)
            found = pa.RecordBatch.from_arrays(
                [pa.array([b[0] for b in blobs], pa.int32()), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), pa.array([b[1] for b in blobs], pa.binary())], names=["bucket", "kind", "id", "mark", "blob"]
            )
            del runs, blobs
            release_memory()
            yield found
            if rows is not None:
                spread = (splitmix(rows.column(1).to_numpy().view(U64)) % U64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(spread), *rows.columns], names=["bucket", *rows.schema.names])
            del found, rows
            release_memory()
        Polynomial.forget()
        release_memory()

    return run


def _blob(runs: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> bytes:
    """Column by column, as that compresses better."""
    head = np.array([len(runs), len(ids)], np.int64).tobytes()
    doc = np.diff(runs["doc"].astype(np.int64), prepend=0).astype(np.int32)
    return zstandard.compress(head + ids.astype(np.int64).tobytes() + mark.tobytes() + doc.tobytes() + b"".join(runs[c].tobytes() for c in _RUN.names if c != "doc"), 1)


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, d = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16
    ids, mark = np.frombuffer(raw, np.int64, d, at), np.frombuffer(raw, np.int64, d, at + 8 * d)
    at += 16 * d
    runs = np.zeros(n, _RUN)
    runs["doc"] = np.cumsum(np.frombuffer(raw, np.int32, n, at))
    at += 4 * n
    for c in _RUN.names:
        if c != "doc":
            runs[c] = np.frombuffer(raw, _RUN[c], n, at)
            at += _RUN[c].itemsize * n
    return runs, ids, mark


def _later(runs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an equal run starts earlier, class number) of each run."""
    own = ids[runs["doc"]]
    order = np.lexsort((runs["pos"], own, runs["check"], runs["key"]))
    key, check = runs["key"][order], runs["check"][order]
    head = np.ones(len(order), bool)
    head[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    number = np.cumsum(head) - 1
    first = order[np.flatnonzero(head)][number]
    later, class_of = np.empty(len(order), bool), np.empty(len(order), np.int64)
    later[order] = (own[order] != own[first]) | (runs["pos"][order] != runs["pos"][first])
    class_of[order] = number
    return later, class_of


def _meet_runs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    kind = table.column("kind").to_numpy()
    known = table.filter(pa.array(kind == 1)).select(["kind", "id", "mark", "blob"])
    yield from known.to_batches()
    parts, ids, marks, n = [], [], [], 0
    for blob in table.filter(pa.array(kind == 0)).column("blob").to_pylist():
        runs, i, m = _unblob(blob)
        runs["doc"] += n
        n += len(i)
        parts.append(runs)
        ids.append(i)
        marks.append(m)
    if not parts:
        return
    runs, ids, marks = np.concatenate(parts), np.concatenate(ids), np.concatenate(marks)
    del parts
    later, class_of = _later(runs, ids)
    gone = runs[later]
    rows = _rows(1, ids, marks, gone["doc"].astype(np.int64), np.stack([gone["pos"].astype(np.int64), gone["pos"].astype(np.int64) + gone["count"] - 1 + WINDOW], 1))
    if rows is not None:
        yield rows
    order = np.lexsort((class_of, runs["anchor"]))
    a, c = runs["anchor"][order], class_of[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.append(start, len(a)))
    several = np.zeros(len(start), bool)
    several |= np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)
    hot = np.maximum.reduceat(runs["hot"][order], start) > 0
    is_open, is_hot = np.empty(len(a), bool), np.empty(len(a), bool)
    is_open[order], is_hot[order] = np.repeat(several | hot, size), np.repeat(hot, size)
    rest = is_open & ~later
    items = np.zeros(rest.sum(), _OPEN)
    for f in ("pos", "count", "lead"):
        items[f] = runs[f][rest]
    items["hot"] = is_hot[rest]
    rows = _rows(2, ids, marks, runs["doc"][rest].astype(np.int64), items)
    if rows is not None:
        yield rows


_FOUND_TYPES = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("mark", pa.int64()), ("blob", pa.binary())])


def _meet_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    out = pa.Table.from_batches([b.cast(_FOUND_TYPES) for b in _meet_runs(table)], _FOUND_TYPES)
    Polynomial.forget()
    release_memory()
    return out


_SLICES = "kind int, id long, mark long, blob binary, key long, pos long, lead int"


def _slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open runs, rows (id, mark, packed text, blobs), as slices: kind 0 with key, pos, lead and their bytes. kind 1: spans known in the batch."""
    one = Polynomial(0)
    for batch in batches:
        ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = [zstandard.decompress(z) for z in batch.column(2).to_pylist()]
        opened = [np.frombuffer(b"".join(b), _OPEN) for b in batch.column(3).to_pylist()]
        keys, docs, poss, leads, blobs = [], [], [], [], []
        hot_key, hot_doc, hot_pos = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, last, data, offsets in joined(texts):
            prefix = one.prefix(data)
            raw = data.tobytes()
            items = np.concatenate(opened[first:last])
            doc = np.repeat(np.arange(last - first), [len(o) for o in opened[first:last]])
            start = offsets[doc] + items["pos"]
            anchor, most, least = start + items["lead"], items["lead"], items["lead"] - items["count"] + 1
            cold = items["hot"] == 0
            for low in range(0, WINDOW - GRAM + 1, SLICE):
                high = min(low + SLICE - 1, WINDOW - GRAM)
                m = cold & (most >= low) & (least <= high)
                s, e = anchor[m] - np.minimum(most[m], high), anchor[m] - np.maximum(least[m], low) + WINDOW
                key = splitmix(one.spans(prefix, anchor[m] - low, anchor[m] - high + WINDOW) + U64(low))
                keys.append(key)
                docs.append(doc[m] + first)
                poss.append(s - offsets[doc[m]])
                leads.append(np.minimum(most[m], high))
                blobs += [raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
            n = items["count"][~cold].astype(np.int64)
            at = np.repeat(start[~cold], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hot_key.append(splitmix(one.spans(prefix, at, at + WINDOW) + U64(101)))
            own = np.repeat(doc[~cold], n)
            hot_doc.append(own + first)
            hot_pos.append(at - offsets[own])
        key, doc, pos = np.concatenate(hot_key), np.concatenate(hot_doc), np.concatenate(hot_pos)
        if len(key):
            order = np.lexsort((pos, ids[doc], key))
            head = np.ones(len(order), bool)
            head[1:] = key[order[1:]] != key[order[:-1]]
            lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
            same = np.fromiter((texts[a][p : p + WINDOW] == texts[b][q : q + WINDOW] for a, p, b, q in zip(doc[order].tolist(), pos[order].tolist(), doc[lead].tolist(), pos[lead].tolist(), strict=True)), bool, len(order))
            late = same & ((ids[doc[order]] != ids[doc[lead]]) | (pos[order] != pos[lead]))
            rows = _rows(1, ids, marks, doc[order[late]], np.stack([pos[order[late]], pos[order[late]] + WINDOW], 1))
            if rows is not None:
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(splitmix(rows.column(1).to_numpy().view(U64)).view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32))], names=[f.split()[0] for f in _SLICES.split(", ")])
            rest = np.sort(order[~late])
            keys.append(key[rest])
            docs.append(doc[rest])
            poss.append(pos[rest])
            leads.append(np.zeros(len(rest), np.int64))
            blobs += [texts[d][p : p + WINDOW] for d, p in zip(doc[rest].tolist(), pos[rest].tolist(), strict=True)]
        doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        if len(doc):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(doc), np.int32)), pa.array(ids[doc]), pa.array(marks[doc]), pa.array(blobs, pa.binary()), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(poss).astype(np.int64)), pa.array(np.concatenate(leads).astype(np.int32))],
                names=[f.split()[0] for f in _SLICES.split(", ")],
            )
        del texts, opened, blobs, keys, docs, poss, leads, key, doc, pos
        release_memory()
    Polynomial.forget()
    release_memory()


def _sorted_spans(key: np.ndarray, ids: np.ndarray, marks: np.ndarray, pos: np.ndarray, lead: np.ndarray, blobs: pa.Array) -> pa.RecordBatch | None:
    """Of slices whose keys come together: the spans of the windows that start earlier too."""
    _, number, size = np.unique(key, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(size[number] > 1)
    if not len(keep):
        return None
    key, ids, marks, pos, lead = number[keep], ids[keep], marks[keep], pos[keep], lead[keep].astype(np.int64)
    chosen = blobs.take(pa.array(keep))
    chosen = chosen.combine_chunks() if isinstance(chosen, pa.ChunkedArray) else chosen
    offsets = np.frombuffer(chosen.buffers()[1], np.int64 if pa.types.is_large_binary(chosen.type) else np.int32)[chosen.offset : chosen.offset + len(chosen) + 1].astype(np.int64)
    data = np.frombuffer(chosen.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = np.diff(offsets) - WINDOW + 1
    row = np.repeat(np.arange(len(key)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = pos[row] + step
    order = np.lexsort((start, ids[row]))  # earlier starts first
    row, step, start = row[order], step[order], start[order]
    group = Suffixes(data, WINDOW).classes(offsets[row] + step, key[row] * 128 + lead[row] - step)
    order = np.argsort(group, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = group[order[1:]] != group[order[:-1]]
    first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    late = order[(ids[row[order]] != ids[row[first]]) | (start[order] != start[first])]
    return _rows(1, ids, marks, row[late], np.stack([start[late], start[late] + WINDOW], 1))


def _meet_slice_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    out = pa.Table.from_batches([b.cast(_FOUND_TYPES) for b in _meet_slices(table)], _FOUND_TYPES)
    Polynomial.forget()
    release_memory()
    return out


def _meet_slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    kind = table.column("kind").to_numpy()
    yield from table.filter(pa.array(kind == 1)).select(["kind", "id", "mark", "blob"]).to_batches()
    table = table.filter(pa.array(kind == 0))
    table = table.set_column(table.schema.get_field_index("blob"), "blob", table.column("blob").cast(pa.large_binary())).sort_by("key").combine_chunks()
    if not table.num_rows:
        return
    key, ids, marks, pos, lead = (table.column(c).to_numpy() for c in ("key", "id", "mark", "pos", "lead"))
    blobs = table.column("blob")  # one chunk, or several where the bytes are over 2 GB
    low = 0
    while low < len(key):  # pieces of whole keys keep the working arrays small
        high = min(low + 20_000, len(key))
        high = int(np.searchsorted(key, key[high - 1], side="right"))
        rows = _sorted_spans(key[low:high], ids[low:high], marks[low:high], pos[low:high], lead[low:high], blobs.slice(low, high - low))
        if rows is not None:
            yield rows
        low = high


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _utf8(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_mark(t) for t in texts], pa.int64()), pa.array([zstandard.compress(t, 3) for t in texts], pa.binary()), *batch.columns[2:]], names=["id", "mark", "packed", *batch.schema.names[2:]])
        del texts
        release_memory()


def _packed(docs: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)
    rest = "".join(f", x{k} {kinds[c]}" for k, c in enumerate(extra))
    return docs.select(as_id(F.col(f"`{id_col}`")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(extra))).mapInArrow(_pack_texts, f"id long, mark long, packed binary{rest}")


#: What Spark says of the size of a table that it doesn't know, as one made from rows, is at least this; its texts are measured instead.
UNKNOWN_BYTES = 1 << 60


def _buckets(docs: DataFrame, texts: DataFrame) -> int:
    """Grows with the input, of which texts (id, text) are a part; at least the session's shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES, 1 << 20)))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, spans): for each text with bytes to remove, packed int64 pairs that may overlap, from one or several rows' blobs."""
    small_batches(docs.sparkSession)
    texts = docs.select(as_id(F.col(f"`{id_col}`")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and text is not null")
    buckets = _buckets(docs, texts)
    runs = texts.mapInArrow(_find_runs(buckets), "bucket int, kind int, id long, mark long, blob binary")
    found = durable(runs.groupBy("bucket").applyInArrow(_meet_group, _FOUND), "runs")
    opened = found.where("kind = 2").groupBy("id", "mark").agg(F.collect_list("blob").alias("blobs"))
    slices = _packed(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, []).join(opened.hint("merge"), ["id", "mark"]).select("id", "mark", "packed", "blobs").mapInArrow(_slice_rows, _SLICES)
    more = slices.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket")).applyInArrow(_meet_slice_group, _FOUND)
    return durable(found.where("kind = 1").union(more).groupBy("id", "mark").agg(F.collect_list("blob").alias("spans")), "spans")


def _cutter(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digest, kept = [], [], [], [], []
            for packed, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = zstandard.decompress(packed)
                cut = np.frombuffer(b"".join(blobs or []), np.int64).reshape(-1, 2)
                cut = _merged(cut[:, 0], cut[:, 1])
                ends = [0, *cut.ravel().tolist(), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(ends[0::2], ends[1::2], strict=True))
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                spans.append(len(cut))
                digest.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(left.decode("utf-8", "ignore"))
            out = {"id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            out |= {"kept": pa.array(kept, pa.string())} if texts else {}
            out |= {n: batch.column(n) for n in batch.schema.names[3:]}
            yield pa.RecordBatch.from_pydict(out)
            del out, kept
            release_memory()

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """docs without the bytes of every 100-byte string that also starts earlier (smaller id, or same text and earlier place).

    Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the remaining bytes. With texts=True also
    all other columns of docs, text_col as what remains (bytes of a character that was cut through are dropped there, not in the digest);
    other columns of the names of the five results are replaced.
    A null text counts as empty. Texts without id lose nothing and make nothing repeat. Rows that repeat an id have the same rank:
    neither is earlier than the other. Texts under 100 bytes stay whole. An empty table gives an empty one.
    """
    digests = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    extra = [c for c in docs.columns if c not in (id_col, text_col, *digests)] if texts else []
    spans = repeated_spans(docs, id_col, text_col)
    # not broadcast: a task would then hold two Python workers, one that packs and one that cuts
    met = _packed(docs, id_col, text_col, extra).join(spans.hint("merge"), ["id", "mark"], "left").select("id", "packed", "spans", *(f"x{k}" for k in range(len(extra))))
    kinds = dict(docs.dtypes)
    rest = "".join(f", x{k} {kinds[c]}" for k, c in enumerate(extra))
    out = met.mapInArrow(_cutter(texts), f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept string' if texts else ''}{rest}")
    if not texts:
        return out.select(F.col("id").alias(id_col), *digests)
    named = {id_col: "id", text_col: "kept"} | {c: f"x{k}" for k, c in enumerate(extra)}
    return out.select(*(F.col(named[c]).alias(c) for c in docs.columns if c in named), *(F.col(c) for c in digests if c not in named))
