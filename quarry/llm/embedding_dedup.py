"""Embedding near-dedup by dual traversal of cover trees: exact pairs of equal label with a cosine at or above a threshold.

1. Equal vectors of a label become one representative with a count, so a vector that many rows hold costs one row for each map task.
2. The tree's top: centers chosen farthest-first from a bounded sample. A vector lives in the cell of its nearest center and visits another
   cell only if the bounds d(x, c) <= R(c) + r and d(x, c) <= d(x, home) + 2r leave room for a partner there (r: the threshold's distance,
   R: the cell's covering radius). Cells are cut into blocks of bounded size.
3. A task gets a block's residents and visitors, builds a cover tree on each (levels with halving radii) and traverses both trees at once.
   It returns how many each vector is linked with and a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.cover_tree import CoverTree, threshold_pairs
from quarry.llm.durable import as_id, durable

#: Vectors from which the top centers are chosen, and the most centers of a label and of all labels.
SAMPLE, CENTERS, MOST_CENTERS = 4096, 8, 1024
#: Residents of a block, and guests that meet them in one task, at most about this many.
BLOCK, GUESTS = 2048, 8192


def _units(column: pa.Array) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return _normed(column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64).reshape(len(column), -1))


def _normed(x: np.ndarray) -> np.ndarray:
    """Unit vectors. Rows are scaled by their largest component first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centers(rows: list) -> dict[tuple[str, int], np.ndarray]:
    """(label, dimension) to centers, farthest first; a label's first center is its first row."""
    by: dict[tuple[str, int], list] = defaultdict(list)
    for r in rows:
        by[r["label"], len(r["embedding"])].append(r["embedding"])
    out, left = {}, MOST_CENTERS
    for key in sorted(by):
        x = _normed(np.array(by[key], np.float64))
        chosen, d = [0], np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < min(CENTERS, left) and d.max() > 0.5:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, np.linalg.norm(x - x[chosen[-1]], axis=1))
        if left > 0:
            out[key] = x[chosen]
            left -= len(chosen)
    return out


def _by_key(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    labels = batch.column(1).dictionary_encode()
    names, label, size = labels.dictionary.to_pylist(), labels.indices.to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
    for at, n in sorted(set(zip(label.tolist(), size.tolist(), strict=True))):
        yield (names[at], n), np.flatnonzero((label == at) & (size == n))


def _homes(centers: dict):
    """(rep, cell, d) of rows (rep, label, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0)
            for key, rows in _by_key(batch):
                if key in centers:
                    d = np.linalg.norm(_units(batch.column(2).take(pa.array(rows)))[:, None, :] - centers[key][None], axis=2)
                    cell[rows], far[rows] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["rep", "label", "embedding", "cell", "d"])

    return run


def _visits(centers: dict, radius: dict, reach: float):
    """Adds `others`: the lower cells that the vector visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d0 = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            others: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for key, rows in _by_key(batch):
                if key not in centers:
                    continue
                d = np.linalg.norm(_units(batch.column(2).take(pa.array(rows)))[:, None, :] - centers[key][None], axis=2)
                bound = np.array([radius.get((*key, c), -9.0) for c in range(len(centers[key]))]) + reach + 1e-7
                visit = (d <= bound) & (d <= d0[rows][:, None] + 2 * reach + 1e-7) & (np.arange(d.shape[1]) < cell[rows][:, None])
                for r, c in zip(*np.nonzero(visit), strict=True):
                    others[rows[r]].append(int(c))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(others, pa.list_(pa.int32()))], names=[*batch.schema.names, "others"])

    return run


def _tasks(cosine: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        home = table.column("resident").to_numpy(zero_copy_only=False)
        rep, count = table.column("rep").to_numpy(), table.column("n").to_numpy()
        links = np.zeros(len(rep), np.int64)
        x = _units(table.column("embedding").combine_chunks())
        edges: list[np.ndarray] = []
        own, guests = np.flatnonzero(home), np.flatnonzero(~home)

        def meet(left: np.ndarray, right: np.ndarray, a: CoverTree, b: CoverTree) -> None:
            for kind, p, q in threshold_pairs(a, b, cosine):
                p, q = left[p], right[q]
                if kind == "point":
                    np.add.at(links, p, count[q])
                    np.add.at(links, q, count[p])
                    edges.append(np.stack([p, q], 1))
                elif len(p) == len(q) and (p == q).all():
                    links[p] += count[p].sum() - count[p]
                    edges.append(np.stack([np.full(len(p) - 1, p[0]), p[1:]], 1))
                else:
                    links[p] += count[q].sum()
                    links[q] += count[p].sum()
                    edges.append(np.stack([np.full(len(q), p[0]), q], 1))
                    edges.append(np.stack([p, np.full(len(p), q[0])], 1))

        tree = CoverTree(x[own]) if len(own) else None
        if tree is not None:
            if table.column("share")[0].as_py() == 0:
                meet(own, own, tree, tree)
            if len(guests):
                meet(guests, own, CoverTree(x[guests]), tree)
        root = np.arange(len(rep))
        pairs = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        while True:  # hook larger roots below smaller ones, then halve paths
            low, high = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]]), np.maximum(root[pairs[:, 0]], root[pairs[:, 1]])
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        live = np.flatnonzero(links > 0)
        return pa.table({"a": pa.array(rep[live]), "b": pa.array(rep[root[live]]), "links": pa.array(links[live])})

    return run


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, n_links, component_id and kept of every row; links join vectors of equal label with cosine >= the threshold.

    Cosines are taken in double precision and the result is exact. Labels of any type are compared as they are. A null label, and a vector that is null, empty, zero or holds null or
    non-finite components, links with nothing; vectors of different length neither. Rows with a null id count in others' n_links
    no more than unlinked ones: they link with nothing, component_id is null and kept true. Rows that repeat an id count one by one
    as links and are one node of a component. An empty table gives an empty one.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    kinds = dict(vectors.dtypes)
    kind = "float" if kinds[vector_col] == "array<float>" else "double"
    e = F.transform(F.col(vector_col), lambda v: v.cast(kind))
    label = F.col(label_col)
    if kinds[label_col] in ("float", "double"):  # both zeros are equal
        label = F.when(label == 0, F.lit(0.0)).otherwise(label)
    rows = vectors.select(as_id(id_col).alias("id"), label.cast("string").alias("label"), e.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    digests = {"h1": F.when(F.col("ok"), F.xxhash64("embedding")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "embedding"))}
    rows = rows.withColumn("ok", ok).withColumns(digests)
    key = ["label", "h1", "h2"]
    good = rows.where("ok")
    classes = good.groupBy(*key).agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = durable(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    sample = classes.select("label", "embedding", "h1", "h2").orderBy("h1", "h2", "label").limit(SAMPLE).collect()
    centers = _centers(sample)
    homes = classes.select("rep", "label", "embedding").mapInArrow(_homes(centers), f"rep long, label string, embedding array<{kind}>, cell int, d double")
    homes = durable(homes.withColumn("dim", F.size("embedding")), "homes")
    cells = homes.groupBy("label", "dim", "cell").agg(F.max("d").alias("r"), F.count("*").alias("m"))
    cells = durable(cells.select("label", "dim", "cell", "r", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "cells")
    top = [k[0] for k in centers]
    radius = {(r["label"], r["dim"], r["cell"]): r["r"] for r in cells.where(F.col("label").isin(top)).collect()} if top else {}
    seen = homes.drop("dim").mapInArrow(_visits(centers, radius, reach), f"rep long, label string, embedding array<{kind}>, cell int, d double, others array<int>")
    seen = seen.withColumn("dim", F.size("embedding")).withColumn("at", F.explode(F.array_append("others", F.col("cell"))))
    crowd = seen.groupBy("label", "dim", "at").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("shares"))
    blocks = cells.select("label", "dim", F.col("cell").alias("at"), "blocks").join(crowd, ["label", "dim", "at"])
    number = lambda n: F.pmod(F.xxhash64("rep", F.hash("embedding")), F.col(n)).cast("int")
    placed = seen.join(blocks, ["label", "dim", "at"]).withColumn("own", F.when(F.col("at") == F.col("cell"), number("blocks")))
    placed = placed.withColumn("block", F.explode(F.sequence(F.coalesce("own", F.lit(0)), F.col("blocks") - 1))).withColumn("resident", F.coalesce(F.col("own") == F.col("block"), F.lit(False)))
    # a block's residents meet its guests share by share, and each other in the first
    all_shares, one_share = F.sequence(F.lit(0), F.col("shares") - 1), F.array(number("shares"))
    placed = placed.withColumn("share", F.explode(F.when(F.col("resident"), all_shares).otherwise(one_share)))
    counted = placed.select("label", "dim", "at", "block", "share", "rep", "embedding", "resident").join(classes.select("rep", "n"), "rep")
    found = durable(counted.groupBy("label", "dim", "at", "block", "share").applyInArrow(_tasks(cosine), "a long, b long, links long"), "links")
    least = classes.select("rep", "least")
    ends = found.select("a", "b").join(least.select(F.col("rep").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("rep").alias("b"), F.col("least").alias("y")), "b")
    comp = components(ends, "x", "y").withColumnRenamed("node", "least")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    per = classes.drop("embedding").join(links, "rep", "left").join(comp, "least", "left")
    per = per.select(*key, F.coalesce("links", F.lit(0)).alias("links"), "n", F.coalesce("component", "least").alias("c"))
    out = rows.select("id", *key).join(per, key, "left")
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
