"""Retrieval kernels for tables of queries: nearest neighbours, BM25 over phrases, rank, filter and fusion.

A query table is small by contract: its rows are collected in blocks and meet all chunks in one pass, so that neither a cross
join nor a shuffle of the corpus is needed; only candidates are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.query_compiler import compile_query
from quarry.functions.text import fold, fold_text
from quarry.model import MOST_FETCHED, MOST_NEIGHBOURS, Corpus, Filters, Fusion, TextIndex, VectorCells, checked_query
from quarry.operators.phrases import blocks_of, grams_of, needed
from quarry.sources.cells import distances
from quarry.storage import BROADCAST_ROWS, at_hand, durable, hinted, plain_unions, spread

#: Queries that one pass over the corpus answers; more make more passes. Text queries of a pass: those have a thousand bytes at most.
BLOCK, TEXT_BLOCK = 4096, 1 << 16


def blocks(queries: DataFrame, *columns: str, most: int | None = None) -> Iterator[list]:
    """Rows of the query table in blocks of bounded size."""
    asked, most = queries.select(*columns), most or BLOCK
    rows = asked.limit(most + 1).collect()
    if len(rows) > most:
        rows = []
        for r in asked.orderBy(columns[0]).toLocalIterator():
            rows.append(r)
            if len(rows) == most:
                yield rows
                rows = []
    if rows:
        yield sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


_NEAR = "query_id long, chunk_id long, distance double"


class _Nearest:
    """The k nearest rows of each query, exact, as a task meets them in parts; ties to the smaller key."""

    def __init__(self, ids: list[int], matrix: np.ndarray, k: int, edges: dict[tuple[int, int], float] | None = None):
        """edges: what the k-th least distances over all tasks are at most."""
        self.ids, self.matrix, self.k, self.norms = ids, matrix, k, (matrix * matrix).sum(1)
        self.edge = np.array([(edges or {}).get((q, 0), np.inf) for q in ids]) ** 2 * (1 + 1e-12)  # the square of the k-th least distance so far
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, keys: np.ndarray, x: np.ndarray, own: np.ndarray | None = None) -> None:
        """own: the places of the queries that ask for these rows, if not all."""
        own = np.arange(len(self.ids)) if own is None else own
        squares = (x * x).sum(1)
        for low in range(0, len(own), 256):
            some = own[low : low + 256]
            q, norms, edge = self.matrix[some], self.norms[some, None], self.edge[some, None]
            d = norms - 2 * q @ x.T + squares
            slack = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (norms + squares)  # the product form rounds by less
            if len(keys) > self.k and not np.isfinite(edge).all():
                edge = np.minimum(edge, np.partition(d + slack, self.k - 1, axis=1)[:, self.k - 1 : self.k])
            open_ = ~(d - slack > edge)  # all that may be among the k nearest, equal vectors too
            for i in np.flatnonzero(open_.any(1)):
                near = np.flatnonzero(open_[i])
                self._keep(some[i], keys[near], np.sqrt(((x[near] - q[i]) ** 2).sum(1)))

    def _keep(self, at: int, keys: np.ndarray, exact: np.ndarray) -> None:
        if at in self.kept:
            keys, exact = np.concatenate([self.kept[at][0], keys]), np.concatenate([self.kept[at][1], exact])
        if len(keys) >= self.k:
            order = np.lexsort((keys, exact))[: self.k]
            keys, exact = keys[order], exact[order]
            if not np.isnan(exact[-1]):
                self.edge[at] = min(self.edge[at], exact[-1] ** 2 * (1 + 1e-12))
        self.kept[at] = keys, exact

    def handed(self, marks: bool = False) -> Iterator[pa.RecordBatch]:
        for at, (keys, exact) in self.kept.items():
            if marks:
                keys, exact = keys[:0], _marks(np.sort(exact), self.k)
            yield pa.RecordBatch.from_arrays([pa.array([self.ids[at]], pa.int64()), pa.array([0], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (keys.astype(np.int64), exact))], names=["query_id", "weight_id", "chunks", "scores"])


def _vectors_of(batch: pa.RecordBatch, dim: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(their rows, the vectors of this length) of a batch (chunk_id, embedding, ..); some: of these rows only."""
    lists = batch.column(1)
    size = np.diff(lists.offsets.to_numpy())
    good = np.flatnonzero(size == dim) if some is None else some[size[some] == dim]
    return good, lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), dim)


def _nearest(ids: list[int], matrix: np.ndarray, k: int, edges: dict[tuple[int, int], float] | None = None, marks: bool = False):
    """_PACKED rows of a task: for each query its k nearest of all rows that the task read, or their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(ids, matrix, k, edges)
        for batch in batches:
            good, x = _vectors_of(batch, matrix.shape[1])
            if len(good):
                best.add(batch.column(0).to_numpy()[good], x)
        yield from _together(best.handed(marks))

    return run


def _nearest_in_cells(ids: list[int], matrix: np.ndarray, asked: dict[int, tuple[list[int], float, float]], k: int):
    """As _nearest(), where each cell is asked by some of the queries and only for rows whose gap lies within its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(ids, matrix, k)
        for batch in batches:
            gap, cell = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            for c in np.unique(cell):
                own, low, high = asked[int(c)]
                good, x = _vectors_of(batch, matrix.shape[1], np.flatnonzero((cell == c) & ~((gap < low) | (gap > high))))
                if len(good):
                    best.add(batch.column(0).to_numpy()[good], x, np.array(own))
        yield from _together(best.handed())

    return run


#: Marks that a task gives of its k best for a query, and candidates of all tasks from which marks are asked for before candidates are handed on.
MARKS, MARKED = 16, 1 << 20


def _marks(scores: np.ndarray, k: int) -> np.ndarray:
    """Every so many of a task's ascending scores: each mark says that a step's number of chunks is not behind it."""
    step = -(-k // MARKS)
    return scores[:k][step - 1 :: step]


def _edges_of(k: int):
    """(query_id, weight_id, edge) of the marks of all tasks, those of one query and weights together: k chunks or more are not behind the edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for q, w, _, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                own.setdefault((q, w), []).append(np.frombuffer(x, np.float64))
        enough = -(-k // -(-k // MARKS))
        found = [(q, w, float(np.sort(x)[enough - 1])) for (q, w), parts in own.items() if len(x := np.concatenate(parts)) >= enough]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.float64()))], names=["query_id", "weight_id", "edge"])

    return run


def _edges(marked: DataFrame, k: int) -> dict[tuple[int, int], float]:
    """A number for each query and weight triple of a block, behind which no task has to hand on chunks. What tasks hand on then is about k chunks for
    each query between them, not k for each task."""
    rows = marked.repartition("query_id", "weight_id").mapInArrow(_edges_of(k), "query_id long, weight_id int, edge double").toArrow()
    return {(q, w): e for q, w, e in zip(*(c.to_pylist() for c in rows.columns), strict=True) if e == e}


def _many(spark: SparkSession, lists: int, k: int) -> bool:
    """Whether k candidates of each list and task are so many that marks are worth a pass."""
    return k >= 4 * MARKS and lists * k * spark.sparkContext.defaultParallelism > MARKED


def _best_of(packed: DataFrame, ids: list[int], k: int) -> DataFrame:
    """(query_id, chunk_id, distance, rank): the k nearest of what the tasks handed on."""
    rows = packed.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_flat({i: [i] for i in ids}, k, True, None), f"{_SCORED}, rank int")
    return rows.select("query_id", "chunk_id", F.col("bm25").alias("distance"), "rank")


def ranked(rows: DataFrame, *order: Column | str, limit: int | None = None) -> DataFrame:
    """rank from 0 within each query; chunk_id settles ties."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "chunk_id")) - 1)
    return out if limit is None else out.where(F.col("rank") < limit)


def _by_length(rows: list) -> Iterator[tuple[list[int], np.ndarray]]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["vector"]), []).append(r)
    for part in by.values():
        yield [r["query_id"] for r in part], np.array([r["vector"] for r in part], np.float64)


#: Queries that search in cells; more leave few cells out between them, and read all vectors once.
IN_CELLS = 64


def knn(vectors: DataFrame, queries: DataFrame, k: int, cells: VectorCells | None = None, report: list | None = None) -> DataFrame:
    """(query_id, chunk_id, distance, rank): for each row (query_id, vector) its k nearest vectors by L2 distance, exact.

    As many tasks as run at once read the vectors; each keeps its k best for each query and hands them on as one row. Vectors of another length than
    the query's never match. cells: the same vectors by cell; if the queries are few then only cells within a query's bound are read. report gets
    (query_id, cells read, vectors in them) of queries, few or not.
    """
    plain_unions(vectors.sparkSession)
    out = None
    for rows in blocks(queries, "query_id", "vector"):
        for ids, matrix in _by_length(rows):
            if cells is not None and (report is not None or len(rows) <= IN_CELLS) and np.isfinite(matrix).all() and matrix.shape[1]:
                found = ranked(_in_cells(cells, ids, matrix, k, report), "distance", limit=k)
            else:
                rows = spread(vectors.select("chunk_id", "embedding"))
                edges = _edges(rows.mapInArrow(_nearest(ids, matrix, k, None, True), _PACKED), k) if _many(rows.sparkSession, len(ids), k) else None
                found = _best_of(rows.mapInArrow(_nearest(ids, matrix, k, edges), _PACKED), ids, k)
            out = found if out is None else out.union(found)
    return vectors.sparkSession.createDataFrame([], f"{_NEAR}, rank int") if out is None else out


#: Rows of a first round that the plan of the second one holds itself; more are stored. Cells whose ranges a scan filters by.
FIRST_ROWS, RANGED = 1 << 16, 64
#: A search for more than one in so many vectors reads them all at once.
BROAD = 8


def _asked(cells: VectorCells, want: np.ndarray, far: np.ndarray, reach: np.ndarray) -> dict[int, tuple[list[int], float, float]]:
    """cell -> (queries, least and largest gap that their bounds reach). want: [query][cell]."""
    out = {}
    for c in np.flatnonzero(want.any(0)):
        own = np.flatnonzero(want[:, c])
        low, high = (far[own, c] - reach[own]).min(), (far[own, c] + reach[own]).max()
        out[cells.cells[c][0]] = own.tolist(), float(low) if np.isfinite(low) else -np.inf, float(high) if np.isfinite(high) else np.inf
    return out


def _round(cells: VectorCells, ids: list[int], matrix: np.ndarray, asked: dict[int, tuple[list[int], float, float]], k: int) -> DataFrame:
    rows = cells.rows.where(F.col("cell").isin(list(asked)))
    if len(asked) <= RANGED and all(np.isfinite(x) for _, *r in asked.values() for x in r):  # files are sorted by gap: row groups outside are skipped
        rows = rows.where(reduce(or_, ((F.col("cell") == c) & F.col("gap").between(low, high) for c, (_, low, high) in asked.items())))
    return _best_of(spread(rows.select("chunk_id", "embedding", "gap", "cell")).mapInArrow(_nearest_in_cells(ids, matrix, asked, k), _PACKED), ids, k).drop("rank")


def _in_cells(cells: VectorCells, ids: list[int], matrix: np.ndarray, k: int, report: list | None) -> DataFrame:
    """The k nearest in two rounds: the nearest cells that hold k vectors give a bound, by which the triangle inequality leaves out cells and rows."""
    same = [c for c in cells.cells if len(c[1]) in (0, matrix.shape[1])]  # a loose cell has no center and is always read
    some = VectorCells(cells.rows, tuple(same))
    if not same:
        return cells.rows.sparkSession.createDataFrame([], _NEAR)
    loose, radius, size = np.array([not c[1] for c in same]), np.array([c[2] for c in same]), np.array([c[3] for c in same])
    far = np.zeros((len(ids), len(same)))
    if not loose.all():
        far[:, ~loose] = distances(matrix, np.array([c[1] for c in same if c[1]]))
    order = np.argsort(np.where(loose, np.inf, far), axis=1, kind="stable")
    before = np.cumsum(np.where(loose, 0, size)[order], axis=1) - np.where(loose, 0, size)[order]
    want = np.zeros_like(far, bool)
    np.put_along_axis(want, order, before < k, axis=1)
    want |= loose
    everything = np.full(len(ids), np.inf)
    if k * BROAD >= size.sum():  # so many neighbours leave little out: one round reads all
        want[:] = True
    if want.all():
        if report is not None:
            report += [(q, len(same), int(size.sum())) for q in ids]
        return _round(some, ids, matrix, _asked(some, want, far, everything), k)
    first = _round(some, ids, matrix, _asked(some, want, far, everything), k)
    held = at_hand(first, FIRST_ROWS) if len(ids) * k <= FIRST_ROWS else None
    first = held[0] if held else durable(first, "nearest")
    edges = held[1].group_by("query_id").aggregate([("distance", "count"), ("distance", "max")]) if held else first.groupBy("query_id").agg(F.count("*").alias("distance_count"), F.max("distance").alias("distance_max")).toArrow()
    bound = {r["query_id"]: r["distance_max"] for r in edges.to_pylist() if r["distance_count"] >= k}  # a number for each query of a block
    reach = np.array([bound.get(q, np.inf) for q in ids])
    reach = np.where(np.isnan(reach), np.inf, reach) * (1 + 1e-9) + 1e-12  # distances round
    more = (far - radius <= reach[:, None]) & ~want
    if report is not None:
        read = want | more
        report += [(q, int(read[i].sum()), int(size[read[i]].sum())) for i, q in enumerate(ids)]
    return first.union(_round(some, ids, matrix, _asked(some, more, far, reach), k)) if more.any() else first


def cells_read(cells: VectorCells, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, cells, cells_read, vectors, vectors_read): what a search for the k nearest reads of the stored cells."""
    report: list = []
    knn(vectors, queries, k, cells, report)
    rows = [(q, len(cells.cells), c, sum(x[3] for x in cells.cells), n) for q, c, n in report]
    return vectors.sparkSession.createDataFrame(rows, "query_id long, cells long, cells_read long, vectors long, vectors_read long")


def query_terms(queries: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """(query_id, folded phrases) of rows (query_id, query), in blocks."""
    for rows in blocks(queries, "query_id", "query", most=TEXT_BLOCK):
        yield [(r["query_id"], list(dict.fromkeys(fold_text(p) for p in compile_query(checked_query(r["query"] or ""))))) for r in rows]


def _asked_once(block: list[tuple[int, list[str]]]) -> tuple[list[str], list[tuple[int, list[int]]], dict[int, list[int]]]:
    """(terms, uses, same): queries of equal phrases are asked once, by the first of them; same has all ids of each."""
    terms = list(dict.fromkeys(t for _, ts in block for t in ts))
    number = {t: i for i, t in enumerate(terms)}
    first: dict[tuple[int, ...], int] = {}
    same: dict[int, list[int]] = {}
    for query_id, ts in block:
        if ts:
            same.setdefault(first.setdefault(tuple(sorted(number[t] for t in ts)), query_id), []).append(query_id)
    return terms, [(q, list(own)) for own, q in first.items()], same


def _text_fields(chunks: DataFrame) -> DataFrame:
    """(chunk_id, heading, context, content), folded: a stored index holds folded fields."""
    ready = "folded_content" in chunks.columns
    names = ("folded_heading", "folded_context", "folded_content") if ready else ("heading", "context_text", "content")
    return chunks.select(F.col("id").alias("chunk_id"), *((F.col(c) if ready else fold(F.col(c))).alias(n) for c, n in zip(names, ("heading", "context", "content"), strict=True)))


#: Chunks of a stored row of found terms: their places take 16 bits at most.
SLICE = 1 << 10


def _occurrences(batch: pa.RecordBatch, machine: _Trie, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows [row, term, heading, context, content] by slices of SLICE chunks, in each by term and row; trigrams of each row) of a batch
    (chunk_id, heading, context, content). A field's texts are looked through as one; what reaches from one into the next is left out.
    size: bytes of each term."""
    length, codes, terms = np.zeros(batch.num_rows, np.int64), [], len(size)
    for f in range(3):
        texts = pc.fill_null(batch.column(f + 1), "").cast(pa.string())
        length += np.maximum(pc.utf8_length(texts).to_numpy().astype(np.int64) - 2, 0)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        for first, term in machine.found(data):
            row = np.searchsorted(offsets[1:], first + offsets[0], "right")
            own = first + offsets[0] + size[term] <= offsets[row + 1]
            row, term = row[own], term[own]
            codes.append(((row // SLICE * terms + term) * SLICE + row % SLICE) * 3 + f)
    code = np.sort(np.concatenate([np.zeros(0, np.int64), *codes]))
    first = np.flatnonzero(np.diff(code, prepend=-1))
    code, n = code[first], np.diff(first, append=len(code))
    place, field = np.divmod(code, 3)
    new = np.diff(place, prepend=-1) > 0
    counts = np.zeros((int(new.sum()), 3), np.int64)
    counts[np.cumsum(new) - 1, field] = n
    place = place[new]
    part, term = place // SLICE // max(terms, 1), place // SLICE % max(terms, 1)
    return np.concatenate([(part * SLICE + place % SLICE)[:, None], term[:, None], counts], 1), length


#: Bytes of text that are looked through together.
PIECE = 1 << 18
#: Entries of a table of all states and bytes; larger tries are looked up by their edges.
TABLE = 1 << 24


class _Trie:
    """Finds terms in texts as UTF-8 bytes: all places of a piece of text go down the trie of the terms together, a byte at a time."""

    def __init__(self, terms: list[bytes]):
        known = sorted({c for t in terms for c in t})
        self.size = len(known) + 1  # class 0 is any byte that no term has, state 0 is where no term goes on
        self.classes = np.zeros(256, np.int64)
        self.classes[known] = np.arange(1, self.size)
        edges: dict[tuple[int, int], int] = {}
        term_of, classes = {}, self.classes.tolist()
        for k, t in enumerate(terms):
            state = 1
            for c in t:
                state = edges.setdefault((state, classes[c]), len(edges) + 2)
            term_of[state] = k
        self.term, self.goes_on = np.full(len(edges) + 2, -1), np.zeros(len(edges) + 2, bool)
        self.term[list(term_of)] = list(term_of.values())
        state, c = np.array(list(edges), np.int64).reshape(-1, 2).T
        self.goes_on[state] = True
        self.edges, self.to, self.next = state * self.size + c, np.fromiter(edges.values(), np.int64, len(edges)), None
        if (entries := (len(edges) + 2) * self.size) <= TABLE:
            self.next = np.zeros(entries, np.int32)
            self.next[self.edges] = self.to
        else:
            order = np.argsort(self.edges)
            self.edges, self.to = self.edges[order], self.to[order]
        self.longest = max(map(len, terms), default=0)
        #: the first bytes are taken together, three if all terms are so long and the table of them stays small
        self.depth = 3 if self.size <= 128 and all(len(t) >= 3 for t in terms) else 1
        self.starts = np.ones(1, np.int64)
        for _ in range(self.depth):
            self.starts = self._after((self.starts[:, None] * self.size + np.arange(self.size)).ravel())

    def _after(self, edge: np.ndarray) -> np.ndarray:
        """The states that edges lead to."""
        if self.next is not None:
            return self.next[edge].astype(np.int64)
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        return np.where(self.edges[at] == edge, self.to[at], 0)

    def found(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first bytes, terms) of all occurrences, overlapping ones too."""
        for low in range(0, len(data) if self.longest else 0, PIECE):
            own = min(PIECE, len(data) - low)
            classes = self.classes[data[low : low + own + self.longest]]
            classes = np.concatenate([classes, np.zeros(own + self.longest - len(classes), np.int64)])
            code = classes[:own]
            for k in range(1, self.depth):
                code = code * self.size + classes[k : own + k]
            state = self.starts[code]
            at = np.flatnonzero(state)
            state = state[at]
            depth = self.depth
            while len(at):
                term = self.term[state]
                if (ends := np.flatnonzero(term >= 0)).size:
                    yield at[ends] + low, term[ends]
                going = np.flatnonzero(self.goes_on[state])
                at = at[going]
                state = self._after(state[going] * self.size + classes[at + depth])
                alive = np.flatnonzero(state)
                at, state, depth = at[alive], state[alive], depth + 1


def _machine(terms: list[str]) -> _Trie:
    return _Trie([t.encode() for t in terms])


def _sizes(terms: list[str]) -> np.ndarray:
    return np.fromiter((len(t.encode()) for t in terms), np.int64, len(terms))


_FOUND = "chunks binary, lengths binary, hits binary, read long, total long"


def _packed(found: np.ndarray) -> bytes:
    """Rows (row, term, heading, context, content) by term and row: numbers of terms and rows, the width of counts, the terms, the rows of each, the
    steps from row to row and the counts, field by field."""
    terms, n = np.unique(found[:, 1], return_counts=True)
    counts = found[:, 2:].T
    small = np.uint8 if not len(found) or counts.max() < 256 else np.int32
    head = np.array([len(terms), len(found), small().itemsize], np.int32)
    steps = np.diff(found[:, 0].astype(np.uint16), prepend=np.uint16(0))  # modulo 2 ** 16
    return b"".join(x.tobytes() for x in (head, np.diff(terms, prepend=0).astype(np.int32), n.astype(np.int32), steps, np.ascontiguousarray(counts.astype(small))))


def _columns_in(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, rows of each, rows by term, [field] counts) that _packed() made a value of."""
    terms, n, width = np.frombuffer(blob, np.int32, 3).tolist()
    rows = np.cumsum(np.frombuffer(blob, np.uint16, n, 12 + 8 * terms), dtype=np.uint16)
    counts = np.frombuffer(blob, np.uint8 if width == 1 else np.int32, 3 * n, 12 + 8 * terms + 2 * n).reshape(3, n)
    return np.cumsum(np.frombuffer(blob, np.int32, terms, 12)), np.frombuffer(blob, np.int32, terms, 12 + 4 * terms), rows, counts


def _hits_in(blob: bytes) -> np.ndarray:
    """The int32 rows (row, term, heading, context, content) that _packed() made a value of."""
    terms, n, rows, counts = _columns_in(blob)
    out = np.empty((len(rows), 5), np.int32)
    out[:, 1], out[:, 0], out[:, 2:] = np.repeat(terms, n), rows, counts.T
    return out


def _finder(terms: list[str]):
    """A row for each slice of chunks that hold terms: their ids and lengths in trigrams as int64 values and what _packed() makes of the terms found.
    For each task a row without chunks has the number of chunks it read and their length, and as int64 values [4][term] how many chunks hold a term, and
    how many in heading, context and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, size, chunks, total = _machine(terms), _sizes(terms), 0, 0
        holding = np.zeros((4, len(terms)), np.int64)
        pack = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (*[pa.binary()] * 3, *[pa.int64()] * 2), strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])
        for batch in batches:
            found, length = _occurrences(batch, machine, size)
            chunks, total = chunks + batch.num_rows, total + int(length.sum())
            for f, own in enumerate((found, *(found[found[:, c] > 0] for c in (2, 3, 4)))):
                holding[f] += np.bincount(own[:, 1], minlength=len(terms))
            keys, part = batch.column(0).to_numpy(), found[:, 0] // SLICE
            for k in np.unique(part).tolist():
                own, low = found[slice(*np.searchsorted(part, [k, k + 1]))].copy(), k * SLICE
                own[:, 0] -= low
                yield pack(keys[low : low + SLICE].astype(np.int64).tobytes(), length[low : low + SLICE].tobytes(), _packed(own), None, None)
        yield pack(None, None, holding.tobytes(), chunks, total)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk ids, lengths, int32 rows [row, term, heading, context, content]) of each of the finder's rows."""
    for batch in batches:
        for keys, length, hits in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if keys is not None:
                yield np.frombuffer(keys, np.int64), np.frombuffer(length, np.int64), _hits_in(hits)


#: Found terms of chunks that a task takes together: what is done once for each query is done once for so many.
GROUP = 1 << 22


def _grouped(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk ids, lengths, rows) of consecutive parts as groups of GROUP rows or more, and the rest."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = chunks = 0
    for keys, length, found in parts:
        found = found.copy()
        found[:, 0] += chunks
        held.append((keys, length, found))
        size, chunks = size + len(found), chunks + len(keys)
        if size >= GROUP:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size, chunks = [], 0, 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _listed(batches: Iterator[pa.RecordBatch], used: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(chunk ids, lengths, rows by term, where each term's rows end, [field] counts) of the finder's rows in groups of twice GROUP found terms or more.
    used: which terms are asked for; others have no rows."""
    held: list[tuple[np.ndarray, ...]] = []
    size = chunks = 0

    def group() -> tuple[np.ndarray, ...]:
        keys, length, term, n, row = (np.concatenate(x) for x in list(zip(*held, strict=True))[:5])
        counts, order = np.concatenate([x[5] for x in held], 1), np.argsort(term, kind="stable")
        start, n = (np.cumsum(n) - n)[order], n[order].astype(np.int64)
        at = _ragged(start, n)
        ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(term[order], np.arange(len(used) + 1))]
        return keys, length, row[at], ends, counts[:, at]

    for batch in batches:
        for keys, length, blob in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if keys is None:
                continue
            term, n, row, counts = _columns_in(blob)
            if not (own := used[term]).all():
                at = _ragged((np.cumsum(n) - n)[own], n[own])
                term, n, row, counts = term[own], n[own], row[at], counts[:, at]
            if not len(row):
                continue
            held.append((np.frombuffer(keys, np.int64), np.frombuffer(length, np.int64), term, n, row + np.int32(chunks), counts))
            size, chunks = size + len(row), chunks + len(keys) // 8
            if size >= 2 * GROUP:
                yield group()
                held.clear()
                size = chunks = 0
    if size:
        yield group()


def _term_counts(n: int):
    """(key, n, heading, context, content): chunks that hold a term, anywhere and in each field, by the term's number, from the finder's rows without
    chunks; under -1 the number of chunks, under -2 their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, n + 2), np.int64)
        for batch in batches:
            for blob, chunks, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[:, :n] += np.frombuffer(blob, np.int64).reshape(4, n)
                total[0, n:] += length, chunks
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.array([*range(n), -2, -1], np.int32)[some]), *(pa.array(t[some]) for t in total)], names=["key", "n", "heading", "context", "content"])

    return run


#: Candidates that a task keeps before it hands them on where all are wanted, and about so many that it keeps where k of each query are.
KEPT = 2_000_000
#: What scores that are equal after rounding differ by at most.
SLACK = 2e-9


class _Best:
    """The k best chunks of each query and weight triple, as a task meets them in groups."""

    def __init__(self, idf: np.ndarray, mean: float, uses: list[tuple[int, list[int]]], weights: list[tuple[int, float, float, float]], k: int | None, edges: dict[tuple[int, int], float] | None = None):
        """edges: what the k-th best scores over all tasks are at most."""
        self.idf, self.mean, self.uses, self.weights, self.k = idf, mean, uses, weights, k
        self.kept: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.edge: dict[tuple[int, int], float] = {}  # the k-th best score so far
        self.floor = np.array([[-(edges or {}).get((q, w), np.inf) - SLACK for q, _ in uses] for w, *_ in weights])  # what a chunk has to be worth for each query, by that
        self.flat = np.array([t for _, own in uses for t in own], np.int64)
        self.starts = np.cumsum([0, *(len(own) for _, own in uses)])[:-1]
        self.held = 0

    def _cut(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
        if self.k is not None and len(keys) > self.k:  # most are told without a sort
            near = score <= np.partition(score, self.k - 1)[self.k - 1] + SLACK
            keys, score = keys[near], score[near]
        order = np.lexsort((keys, np.round(score, 9)))[: self.k]
        return keys[order], score[order]

    def _join(self, at: tuple[int, int], keys: np.ndarray, score: np.ndarray) -> None:
        """Adds to a list; what its k-th best tells to be behind is dropped, equal ones in full when they grow too many."""
        if at in self.kept:
            keys, score = np.concatenate([self.kept[at][0][0], keys]), np.concatenate([self.kept[at][0][1], score])
        if len(keys) >= self.k:
            self.edge[at] = float(np.partition(score, self.k - 1)[self.k - 1])
            if len(keys) > self.k:
                near = score <= self.edge[at] + SLACK
                keys, score = keys[near], score[near]
            if len(keys) > 2 * self.k:
                keys, score = self._cut([(keys, score)])
        self.kept[at] = [(keys, score)]

    def worth(self, tf: np.ndarray, length: np.ndarray | float, term: np.ndarray | int) -> np.ndarray:
        return self.idf[term] * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / self.mean))

    def beaten(self, most: dict[int, tuple[np.ndarray, int]]) -> bool:
        """Whether no chunk of a block can enter any list, by the most that each phrase can be worth there."""
        if self.k is None:
            return False
        for weight_id, *w in self.weights:
            bound = {t: float(self.worth(counts @ np.array(w), least, t)) for t, (counts, least) in most.items()}
            for query_id, own in self.uses:
                edge = self.edge.get((query_id, weight_id))
                reach = sum(bound.get(t, 0.0) for t in own)
                if reach > 0 and (edge is None or -reach <= edge + SLACK):
                    return False
        return True

    def add(self, keys: np.ndarray, length: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Scores chunks by rows (row, term, heading, context, content); hands on what is kept when all is wanted and it grows too large."""
        if len(found):
            found = found[np.argsort(found[:, 1], kind="stable")]
            yield from self.add_lists(keys, length, found[:, 0], np.searchsorted(found[:, 1], np.arange(len(self.idf) + 1)), found[:, 2:].T)

    def add_lists(self, keys: np.ndarray, length: np.ndarray, row: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """As add(), from rows by term, in each ascending, where each term's rows end, and their counts by field."""
        n = np.diff(ends)
        held, long, term = n > 0, length[row], np.repeat(np.arange(len(n)), n)
        there = np.maximum.reduceat(held[self.flat], self.starts)
        for w_at, (weight_id, *w) in enumerate(self.weights):
            worth = self.worth(counts[0] * w[0] + counts[1] * w[1] + counts[2] * w[2], long, term)
            if self.k is None:
                self._keep_all(weight_id, keys, row, ends, worth, there)
                continue
            most = np.zeros(len(self.idf))
            most[held] = np.maximum.reduceat(worth, ends[:-1][held])
            hopeful = np.flatnonzero(there & (np.add.reduceat(most[self.flat], self.starts) >= self.floor[w_at] - SLACK))
            if not len(hopeful):
                continue
            lists = _Lists(row, worth, term, ends, most, len(keys))
            for q, rows, score in lists.best(*_of_each(self.flat, self.starts, hopeful), self.floor[w_at, hopeful], self.k):
                cuts = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    q_at = hopeful[q[low]]
                    at = self.uses[q_at][0], weight_id
                    self._join(at, keys[rows[low:high]], -score[low:high])
                    if at in self.edge:
                        self.floor[w_at, q_at] = max(self.floor[w_at, q_at], -self.edge[at] - SLACK)
        if self.held > KEPT:
            yield from self.handed()

    def _keep_all(self, weight_id: int, keys: np.ndarray, row: np.ndarray, ends: np.ndarray, worth: np.ndarray, there: np.ndarray) -> None:
        total, ends = np.zeros(len(keys)), ends.tolist()
        for q_at in np.flatnonzero(there).tolist():
            query_id, own = self.uses[q_at]
            for t in own:
                total[row[ends[t] : ends[t + 1]]] += worth[ends[t] : ends[t + 1]]
            rows = np.unique(np.concatenate([row[ends[t] : ends[t + 1]] for t in own]))
            self.kept.setdefault((query_id, weight_id), []).append((keys[rows], -total[rows]))
            total[rows] = 0
            self.held += len(rows)

    def handed(self, marks: bool = False) -> Iterator[pa.RecordBatch]:
        """A row for each query and weight triple, or more if there are many candidates. marks: those only."""
        for row in self.rows(marks):
            yield _batch_of([row])

    def rows(self, marks: bool = False) -> Iterator[tuple[int, int, bytes, bytes]]:
        for (query_id, weight_id), parts in self.kept.items():
            if marks:
                score = _marks(np.sort(np.concatenate([x for _, x in parts])), self.k)
                keys = np.zeros(len(score), np.int64)
            else:
                keys, score = self._cut(parts)
            for low in range(0, len(keys), 1 << 16):
                yield query_id, weight_id, keys[low : low + (1 << 16)].astype(np.int64).tobytes(), score[low : low + (1 << 16)].tobytes()
        self.kept.clear()
        self.held = 0


def _ragged(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as n says."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _of_each(flat: np.ndarray, starts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of some of the parts of flat one behind the other, how many each has)."""
    n = np.diff(starts, append=len(flat))[some]
    return flat[_ragged(starts[some], n)], n


#: Candidates that are scored at once.
SCORED = 1 << 19


class _Lists:
    """The rows of each term in a group of chunks, ascending and by what they are worth under one weight triple."""

    def __init__(self, row: np.ndarray, worth: np.ndarray, term: np.ndarray, ends: np.ndarray, most: np.ndarray, chunks: int):
        self.worth, self.n, self.first, self.most, self.chunks = worth, np.diff(ends), ends[:-1], most, chunks
        self.top = float(worth.max()) or 1.0
        self.place = term * chunks + row  # ascending
        self.key = 2.0 * term - worth / self.top
        order = np.argsort(self.key)
        self.key, self.row = self.key[order], row[order]

    def heads(self, term: np.ndarray, share: np.ndarray) -> np.ndarray:
        """How many of each term's best rows are worth its share; some that are not may be counted too."""
        return np.searchsorted(self.key, 2.0 * term - np.clip(share / self.top, 0, 1.5) + 1e-9, "right") - self.first[term]

    def shared(self, term: np.ndarray, size: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """How many of the best rows of each query's terms have to be scored to find all that is worth floor.

        What is worth floor holds, for any shares of it that the terms are given, a term that is worth its share. Of a few ways to share it each query
        takes the one that leaves the fewest rows."""
        query, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        floor, most = np.maximum(floor, 0)[query], self.most[term]
        order = np.lexsort((-self.n[term], query))
        before = np.cumsum(most[order]) - most[order]
        first = np.empty(len(term))  # longer lists first: their share may be more than any of their rows is worth
        first[order] = np.clip(floor - (before - before[starts][query]), 0, most[order] * (1 + 1e-9))
        even = floor * most / np.add.reduceat(most, starts)[query]
        least = total = None
        for part in (0.0, 0.5, 1.0):
            n = self.heads(term, part * even + (1 - part) * first)
            sums = np.add.reduceat(n, starts)
            if least is None:
                least, total = n, sums
            else:
                least, total = np.where((sums < total)[query], n, least), np.minimum(sums, total)
        return least

    def scored(self, term: np.ndarray, size: np.ndarray, heads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries by their places, rows, scores) of the heads of the queries' terms, by query, each query in one part."""
        starts = np.cumsum(size) - size
        ends = np.cumsum(np.add.reduceat(heads, starts))
        low = 0
        while low < len(size):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SCORED, "right")))
            own = slice(starts[low], starts[high] if high < len(size) else len(term))
            n = heads[own]
            code = np.repeat(np.repeat(np.arange(low, high), size[low:high]), n) * self.chunks + self.row[_ragged(self.first[term[own]], n)]
            code.sort()
            query, row = np.divmod(code[np.diff(code, prepend=-1) > 0], self.chunks)
            score = np.zeros(len(row))
            for j in range(int(size[low:high].max())):
                some = np.flatnonzero(size[query] > j)
                want = term[starts[query[some]] + j] * self.chunks + row[some]
                at = np.minimum(np.searchsorted(self.place, want), len(self.place) - 1)
                score[some] += np.where(self.place[at] == want, self.worth[at], 0.0)
            yield query, row, score
            low = high

    def best(self, term: np.ndarray, size: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries by their places, rows, scores) of all rows that are worth their query's floor and among its k best, and maybe some behind them.

        term: the terms of the queries, one query's behind the other's; size: how many each has. Where no floor is known the k-th best of a term by
        itself is one, and where that leaves many rows, the k-th best of the heads of the terms' lists."""
        starts = np.cumsum(size) - size
        enough = (self.n[term] >= k) & np.repeat(floor == -np.inf, size)
        single = np.full(len(term), -np.inf)
        single[enough] = (2.0 * term[enough] - self.key[self.first[term[enough]] + k - 1]) * self.top * (1 - 1e-9) - SLACK
        floor = np.maximum(floor, np.maximum.reduceat(single, starts))
        heads = self.shared(term, size, floor)
        wide = np.flatnonzero(np.add.reduceat(heads, starts) > 4 * k * size)
        if len(wide):
            own, n = _of_each(term, starts, wide)
            for query, _, score in self.scored(own, n, np.minimum(self.n[own], 2 * k)):
                order = np.lexsort((-score, query))
                at = np.searchsorted(query, np.arange(query[0], query[-1] + 2))
                full = np.flatnonzero(np.diff(at) >= k)
                of = wide[query[0] + full]
                floor[of] = np.maximum(floor[of], score[order[at[full] + k - 1]] - SLACK)
            heads = self.shared(term, size, floor)
        for query, row, score in self.scored(term, size, heads):
            near = score >= floor[query]
            if near.any():
                yield query[near], row[near], score[near]


def _batch_of(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    types = pa.int64(), pa.int32(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["query_id", "weight_id", "chunks", "scores"])


def _together(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Small batches joined into larger ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if len(held) == rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: Of each task the k best chunks of each query and weights, as int64 and float64 values.
_PACKED = "query_id long, weight_id int, chunks binary, scores binary"


def _scores(*options, marks: bool = False):
    """_PACKED rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            best = _Best(*options)
            used = np.zeros(len(best.idf), bool)
            used[best.flat] = True
            for group in _listed(batches, used):
                yield from best.add_lists(*group)
            rows = best.rows(marks)
            while part := list(islice(rows, 256)):
                yield _batch_of(part)

        yield from _together(found(), 64)

    return run


def _index_counts(terms: list[str], *dead):
    """(key, n): chunks that hold a term, by the term's number, from rows of the text index."""
    grams = [grams_of(t) for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for block in blocks_of(batches, *dead):
            total += np.bincount(block.hits(grams, list(range(len(terms))))[:, 1], minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms), dtype=np.int32)), pa.array(total)], names=["key", "n"])

    return run


def _index_scores(terms: list[str], dead: tuple, *options):
    """As _scores(), from rows of the text index. A block whose bounds are beaten is passed over before a place of it is read."""
    grams = [grams_of(t) for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            best = _Best(*options)
            for block in blocks_of(batches, *dead):
                most = {t: m for t, g in enumerate(grams) if (m := block.most(g)) is not None}
                if most and not best.beaten(most):
                    yield from best.add(block.ids, block.lengths, block.hits(grams, list(most)))
            yield from best.handed()

        yield from _together(found())

    return run


def _flat(same: dict[int, list[int]], k: int | None, ranks: bool, digits: int | None = 9):
    """_PACKED rows, those of one query and weights together, as rows (query_id, weight_id, chunk_id, bm25) and with ranks the rank of the k best
    after rounding, for all queries that ask the same."""
    names = ["query_id", "weight_id", "chunk_id", "bm25"] + ["rank"] * ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(at: tuple[int, int], parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            keys, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            if ranks:
                order = np.lexsort((keys, score if digits is None else np.round(score, digits)))[:k]
                keys, score = keys[order], score[order]
            n = len(keys)
            for query_id in same[at[0]]:
                columns = [pa.array([query_id], pa.int64()).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, at[1], np.int32)), pa.array(keys), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(np.arange(n, dtype=np.int32))] * ranks, names=names)

        def found() -> Iterator[pa.RecordBatch]:
            own, parts = None, []
            for batch in batches:
                for q, w, c, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                    if parts and (own != (q, w) or not ranks):
                        yield from rows(own, parts)
                        parts = []
                    own = q, w
                    parts.append((np.frombuffer(c, np.int64), np.frombuffer(x, np.float64)))
            if parts:
                yield from rows(own, parts)

        yield from _together(found(), 64)

    return run


#: Phrases for which the text index is read. More need most of its buckets: then one pass over the chunks finds all of them at once.
LOOKED_UP = 64


def _by_index(text: TextIndex | None, terms: list[str]) -> bool:
    return text is not None and len(terms) <= LOOKED_UP and all(len(t) >= 3 for t in terms)


#: How rows of found terms are stored: a reader holds a row group of them.
SLICED = {"compression": "zstd", "parquet.block.size": 16 << 20}


def _phrases(fields: DataFrame, terms: list[str]) -> tuple[DataFrame, dict[int, int], dict[int, tuple[bool, ...]]]:
    """(_FOUND rows of all chunks, stored; chunks that hold each term, their number under -1 and length under -2; the fields in which each term occurs)."""
    found = durable(spread(fields).mapInArrow(_finder(terms), _FOUND), "phrases", **SLICED)
    ends = spread(found.where("read is not null").select("hits", "read", "total"))  # row groups without such a row are skipped
    names = "n", "heading", "context", "content"
    counts = ends.mapInArrow(_term_counts(len(terms)), ", ".join(["key int", *(f"{c} long" for c in names)])).groupBy("key").agg(*(F.sum(c).alias(c) for c in names)).collect()
    return found, {r["key"]: r["n"] for r in counts}, {r["key"]: tuple(r[c] > 0 for c in names[1:]) for r in counts}


def _rarity(counted: dict[int, int], terms: int, n: int) -> np.ndarray:
    df = np.array([counted.get(t, 0) for t in range(terms)], float)
    idf = np.log((n - df + 0.5) / (df + 0.5))
    return np.where(idf > 0, idf, 1e-6)


def _passes(uses: list[tuple[int, list[int]]], counted: dict[int, int], most: int) -> Iterator[list[tuple[int, list[int]]]]:
    """The queries in parts of so many. Those of one most frequent term lie together, so that its rows are read for few parts."""
    if len(uses) > most:
        uses = sorted(uses, key=lambda u: max((counted.get(t, 0), t) for t in u[1]))
    for low in range(0, len(uses), most):
        yield uses[low : low + most]


def _bests(found: DataFrame, k: int, *options) -> DataFrame:
    """_PACKED rows of all tasks from stored rows of found terms. options: as _Best() has them before k."""
    edges = (_edges(spread(found).mapInArrow(_scores(*options, k, marks=True), _PACKED), k),) if _many(found.sparkSession, len(options[2]) * len(options[3]), k) else ()
    return spread(found).mapInArrow(_scores(*options, k, *edges), _PACKED)


def bm25(chunks: DataFrame, queries: DataFrame, weights: DataFrame, k: int | None = None, text: TextIndex | None = None, matches: list[DataFrame] | None = None) -> DataFrame:
    """(query_id, weight_id, chunk_id, bm25, rank): lower is better, as full-text engines report it.

    queries: (query_id, query) or, compiled, (query_id, phrases). weights: (weight_id, heading, context, content), a few rows. k1 is 1.2 and
    b 0.75; a chunk's length is the number of its trigrams over all fields; a phrase's frequency is the weighted sum of its occurrences.

    With a text index and few phrases only the buckets of the phrases' trigrams are read, once to count the chunks that hold each phrase and
    once to score them, where a block that can't reach a task's k best is passed over. Else one pass over the chunks finds the phrases of all
    queries and stores them, and as many tasks as run at once score those, group by group: what can't reach a query's k-th best in the task is
    left out. Queries of equal phrases are scored once. A number for each phrase reaches the driver; of a task k chunks for each query are
    shuffled, as one row, and there are no more tasks with more chunks. matches gets the parts of match_counts(), counted on what is stored for this.
    """
    spark = chunks.sparkSession
    plain_unions(spark)
    fields = _text_fields(chunks)
    triples = [(r["weight_id"], r["heading"], r["context"], r["content"]) for r in weights.collect()]
    out = None
    source = query_terms(queries) if "query" in queries.columns else ([(r["query_id"], [fold_text(p) for p in r["phrases"]]) for r in rows] for rows in blocks(queries, "query_id", "phrases", most=TEXT_BLOCK))
    for block in source:
        terms, uses, same = _asked_once(block)
        if not terms:
            continue
        if _by_index(text, terms):
            rows, found = needed(text, terms), None
            counted = {r["key"]: r["n"] for r in rows.mapInArrow(_index_counts(terms, text.dead, text.stride), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}
            n, length = text.chunks, text.length
        else:
            found, counted, _ = _phrases(fields, terms)
            n, length = counted.get(-1, 0), counted.get(-2, 0)
        if matches is not None:
            matches.append(spread(found).mapInArrow(_found_matching(len(terms), uses, same), _MATCHES) if found is not None else rows.mapInArrow(_index_matching(terms, uses, same, text.dead, text.stride), _MATCHES))
        idf, mean = _rarity(counted, len(terms), n), length / max(n, 1) or 1.0
        step = len(uses) if k is None else max(1, STATE // (max(k, 1) * len(triples)))
        for some in _passes(uses, counted, step):
            options = idf, mean, some, triples
            if found is None:
                part = rows.mapInArrow(_index_scores(terms, (text.dead, text.stride), *options, k), _PACKED)
            else:
                part = spread(found).mapInArrow(_scores(*options, None), _PACKED) if k is None else _bests(found, k, *options)
            if k is None:
                part = part.mapInArrow(_flat(same, None, False), _SCORED)
            else:
                part = part.repartition("query_id", "weight_id").sortWithinPartitions("query_id", "weight_id").mapInArrow(_flat(same, k, True), f"{_SCORED}, rank int")
            out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], _SCORED if k is None else f"{_SCORED}, rank int")
    if k is not None:
        return out
    window = Window.partitionBy("query_id", "weight_id").orderBy(F.round("bm25", 9), "chunk_id")
    return out.withColumn("rank", F.row_number().over(window) - 1)


_ORDERS = "query_id long, chunks array<long>, orders binary"


def _apart(triples: list[tuple[float, float, float]], fields: tuple[bool, ...]) -> list[int]:
    """For each triple the first one that weighs those fields as it does: where all that is found stands in them, both score alike."""
    first: dict[tuple[float, ...], int] = {}
    return [first.setdefault(tuple(x for x, there in zip(w, fields, strict=True) if there), n) for n, w in enumerate(triples)]


def _ordering(same: dict[int, list[int]], alike: list[int], k: int):
    """Of _PACKED rows, those of one query together, the order of its chunks under each triple, for all queries that ask the same.
    alike: for each triple the one whose order it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(q: int, parts: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            best = {}
            for w, own in parts.items():
                keys, score = (np.concatenate(x) for x in zip(*own, strict=True))
                best[w] = keys[np.lexsort((keys, np.round(score, 9)))[:k]]
            some = np.unique(np.concatenate(list(best.values())))
            rows = {w: np.pad(np.searchsorted(some, keys), (0, k - len(keys)), constant_values=-1).astype(np.int32) for w, keys in best.items()}
            orders = np.stack([rows[w] for w in alike])
            for query_id in same[q]:
                yield pa.RecordBatch.from_arrays([pa.array([query_id], pa.int64()), pa.array([some], pa.list_(pa.int64())), pa.array([orders.tobytes()], pa.binary())], names=[c.split()[0] for c in _ORDERS.split(", ")])

        def found() -> Iterator[pa.RecordBatch]:
            own, parts = None, {}
            for batch in batches:
                for q, w, c, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                    if q != own and parts:
                        yield from done(own, parts)
                        parts = {}
                    own = q
                    parts.setdefault(w, []).append((np.frombuffer(c, np.int64), np.frombuffer(x, np.float64)))
            if parts:
                yield from done(own, parts)

        yield from _together(found(), 16)

    return run


#: Queries of a pass of text_orders().
POOLED = 1 << 14


def text_orders(chunks: DataFrame, queries: DataFrame, triples: list[tuple[float, float, float]], k: int) -> DataFrame:
    """(query_id, chunks, orders): bm25() under many weight triples at once. chunks are those among the k best under any triple, orders are int32
    values [triple][rank] of their places in chunks, -1 behind the last. A query without hits has no row.

    A query is scored once for all triples that weigh alike the fields in which its terms occur anywhere: most occur in the content only."""
    plain_unions(chunks.sparkSession)
    out = None
    for block in query_terms(queries):
        terms, uses, same = _asked_once(block)
        if not terms:
            continue
        found, counted, fields = _phrases(_text_fields(chunks), terms)
        n = counted.get(-1, 0)
        idf, mean = _rarity(counted, len(terms), n), counted.get(-2, 0) / max(n, 1) or 1.0
        parts: dict[tuple[bool, ...], list[tuple[int, list[int]]]] = {}
        for use in uses:
            if there := [fields[t] for t in use[1] if t in fields]:
                parts.setdefault(tuple(map(any, zip(*there, strict=True))), []).append(use)
        for own, asked in parts.items():
            alike = _apart(triples, own)
            weights = [(w, *triples[w]) for w in sorted(set(alike))]
            for some in _passes(asked, counted, max(1, min(POOLED, STATE // (max(k, 1) * len(weights))))):
                part = _bests(found, k, idf, mean, some, weights).repartition("query_id").sortWithinPartitions("query_id", "weight_id")
                part = part.mapInArrow(_ordering({q: same[q] for q, _ in some}, alike, k), _ORDERS)
                out = part if out is None else out.union(part)
    return chunks.sparkSession.createDataFrame([], _ORDERS) if out is None else out


_SCORED = "query_id long, weight_id int, chunk_id long, bm25 double"
#: Candidates of all queries of a pass over the found phrases that a task may hold.
STATE = 8_000_000


_MATCHES = "query_id long, matches long"


def summed_matches(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    """(query_id, matches) of parts of match_counts()."""
    out = spark.createDataFrame([], _MATCHES)
    for part in parts:
        out = out.union(part)
    return out.groupBy("query_id").agg(F.sum("matches").alias("matches")).where("matches > 0")


def match_counts(chunks: DataFrame, queries: DataFrame, text: TextIndex | None = None) -> DataFrame:
    """(query_id, matches): chunks that hold at least one phrase of the query."""
    plain_unions(chunks.sparkSession)
    fields, parts = _text_fields(chunks), []
    for block in query_terms(queries):
        terms, uses, same = _asked_once(block)
        if not terms:
            continue
        rows, run = (needed(text, terms), _index_matching(terms, uses, same, text.dead, text.stride)) if _by_index(text, terms) else (spread(fields), _matching(terms, uses, same))
        parts.append(rows.mapInArrow(run, _MATCHES))
    return summed_matches(parts, chunks.sparkSession)


def _counted(total: np.ndarray, uses: list[tuple[int, list[int]]], chunks: int, found: np.ndarray, terms: int) -> None:
    """Adds to the counts of all queries the chunks of a group that hold one of their terms."""
    found = found[np.argsort(found[:, 1], kind="stable")]
    row, ends = found[:, 0], np.searchsorted(found[:, 1], np.arange(terms + 1)).tolist()
    seen = np.zeros(chunks, bool)
    for i, (_, own) in enumerate(uses):
        lists = [row[ends[t] : ends[t + 1]] for t in own if ends[t] < ends[t + 1]]
        if not lists:
            continue
        lists.sort(key=len, reverse=True)
        total[i] += len(lists[0])  # a chunk has one row for a term
        if len(lists) > 1:
            for k, x in enumerate(lists[:-1], 1):
                seen[x] = True
                new = ~seen[lists[k]]
                total[i] += int(new.sum())
            for x in lists[:-1]:
                seen[x] = False


def _counts_of(total: np.ndarray, uses: list[tuple[int, list[int]]], same: dict[int, list[int]]) -> pa.RecordBatch:
    some = [(q, int(n)) for (first, _), n in zip(uses, total, strict=True) if n for q in same[first]]
    return pa.RecordBatch.from_arrays([pa.array([q for q, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], names=["query_id", "matches"])


def _found_matching(terms: int, uses: list[tuple[int, list[int]]], same: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(uses), np.int64)
        for keys, _, found in _grouped(_unpacked(batches)):
            _counted(total, uses, len(keys), found, terms)
        yield _counts_of(total, uses, same)

    return run


def _matching(terms: list[str], uses: list[tuple[int, list[int]]], same: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, size, total = _machine(terms), _sizes(terms), np.zeros(len(uses), np.int64)
        parts = ((b.column(0).to_numpy(), np.zeros(b.num_rows, np.int8), _occurrences(b, machine, size)[0].astype(np.int32)) for b in batches)
        for keys, _, found in _grouped(parts):
            _counted(total, uses, len(keys), found, len(terms))
        yield _counts_of(total, uses, same)

    return run


def _index_matching(terms: list[str], uses: list[tuple[int, list[int]]], same: dict[int, list[int]], *dead):
    grams = [grams_of(t) for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(uses), np.int64)
        for block in blocks_of(batches, *dead):
            _counted(total, uses, len(block.ids), block.hits(grams, list(range(len(terms)))), len(terms))
        yield _counts_of(total, uses, same)

    return run


def weight_table(spark: SparkSession, *triples: tuple[float, float, float]) -> DataFrame:
    columns = [pa.array(range(len(triples)), pa.int32()), *(pa.array([float(t[c]) for t in triples]) for c in range(3))]
    return spark.createDataFrame(pa.table(columns, names=["weight_id", "heading", "context", "content"]))


#: Ids of one broadcast by which chunks are picked.
MOST_IDS = 1 << 20


def picked(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """The chunks that stored candidates name, so that a join shuffles the texts of no others. Ids are broadcast in parts of about MOST_IDS."""
    ids = candidates.select(F.col("chunk_id").alias("__own")).distinct()
    parts = ids.count() // MOST_IDS + 1
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(parts)) == k
    plain_unions(chunks.sparkSession)
    return reduce(DataFrame.union, (chunks.where(part("id", k)).join(F.broadcast(ids.where(part("__own", k))), F.col("id") == F.col("__own"), "left_semi") for k in range(parts)))


def attach(candidates: DataFrame, corpus: Corpus) -> DataFrame:
    """Chunk and document columns of candidates."""
    c = corpus.chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "heading", "content", "token_count", "quality_score", "context_text")
    d = corpus.documents.select(F.col("id").alias("document_id"), "path", "title", "topic", "category", "tags", "date")
    return candidates.join(c, "chunk_id").join(d, "document_id")


def filtered(candidates: DataFrame, corpus: Corpus, filters: Filters, limit: int, most: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rank) of candidates that were cut by rank first, then filtered, ranked anew and cut at the limit.

    most: candidates that there can be. If they are few by that they are broadcast to the chunks' ids and the columns that are filtered by;
    else they are stored and counted first.
    """
    from quarry.operators.predicates import predicate

    cut = candidates.select("query_id", "chunk_id", "rank")
    few = F.broadcast(cut) if most is not None and most <= BROADCAST_ROWS else hinted(durable(cut, "candidates"))
    kept = attach(few, corpus).where(predicate(filters)).select("query_id", "chunk_id", "rank")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1).where(F.col("rank") < limit)


def vector_leg(corpus: Corpus, queries: DataFrame, filters: Filters, limit: int, asked: int | None = None) -> DataFrame:
    """asked: how many queries there are at most, if that is known."""
    fetch = min(filters.fetch(limit), MOST_NEIGHBOURS)
    return filtered(knn(corpus.vectors, queries, fetch, corpus.cells), corpus, filters, limit, asked and asked * fetch)


def text_leg(corpus: Corpus, queries: DataFrame, filters: Filters, fusion: Fusion, limit: int, asked: int | None = None, matches: list[DataFrame] | None = None) -> DataFrame:
    """matches gets the parts of match_counts()."""
    fetch = min(filters.fetch(limit), MOST_FETCHED)
    found = bm25(corpus.chunks, queries, weight_table(corpus.chunks.sparkSession, fusion.weights), fetch, corpus.text, matches).drop("weight_id")
    return filtered(found, corpus, filters, limit, asked and asked * fetch)


def fuse(legs: list[DataFrame], k: float, limit: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): reciprocal ranks 1 / (k + rank + 1) summed over ranked lists; ties by id."""
    plain_unions(legs[0].sparkSession)
    parts = [leg.select("query_id", "chunk_id", (1.0 / (F.lit(float(k)) + F.col("rank") + 1)).alias("part")) for leg in legs]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    score = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return ranked(score, F.desc("score"), limit=limit)
