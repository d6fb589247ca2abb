"""Stored vectors by cell: each vector lies with the nearest of some centers, so that a search reads only cells that its bound reaches.

Centers come from a bounded sample. What makes the search exact is measured over all vectors: a cell's radius is the largest distance of a
member from its center, and each row keeps its own distance, by which a cell's files are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.model import VectorCells
from quarry.storage import plain_unions

#: Vectors that centers are chosen from; vectors a cell shall have about, and the most cells of a length of vectors; vectors of a written file.
SAMPLED, CELL_VECTORS, MOST_CELLS, FILE_VECTORS = 4096, 256, 2048, 1 << 20
#: The cell of vectors that have no distance to anything: empty ones, or with a component that is null or not finite. Every search reads it.
LOOSE = -1
SCHEMA = "chunk_id long, embedding array<float>, gap double, cell long"


def choose_centers(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centers of the rows of x: the farthest from those chosen before, then moved to the mean of their nearest rows."""
    n = min(n, len(x))
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    centers = x[chosen]
    for _ in range(rounds):
        own = nearest_center(x, centers)
        count = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers


def nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row by products of matrices; of centers that are as near but for rounding either, as any cell will do."""
    squares = (centers * centers).sum(1)
    return np.concatenate([(squares - 2 * x[low : low + 4096] @ centers.T).argmin(1) for low in range(0, max(len(x), 1), 4096)])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """L2 distances of all rows of x to all rows of y, summed difference by difference, in parts."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for low in range(0, len(x), step):
        out[low : low + step] = np.sqrt(((x[low : low + step, None] - y[None]) ** 2).sum(2))
    return out


def _placed(centers: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Adds gap and cell to rows (chunk_id, embedding). centers: length of vectors -> (cells, centers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            gap, cell = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, LOOSE, np.int64)
            for dim, (cells, own) in centers.items():
                some = np.flatnonzero(size == dim)
                if len(some):
                    x = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    good = np.isfinite(x).all(1)
                    best = nearest_center(x[good], own)
                    gap[some[good]], cell[some[good]] = np.sqrt(((x[good] - own[best]) ** 2).sum(1)), cells[best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(gap), pa.array(cell)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def write_cells(vectors: DataFrame, folder: str, first: int = 0) -> None:
    """Writes vectors by cell under folder/rows, and the cells, numbered from first on, with center, radius and size under folder/cells."""
    spark = vectors.sparkSession
    counts = {r["dim"]: r["n"] for r in vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).where("dim > 0").collect()}
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    centers, base = {}, first
    for dim, n in sorted(counts.items()):
        rows = vectors.where((F.size("embedding") == dim) & finite).orderBy(F.xxhash64("chunk_id"), "chunk_id").select("embedding").limit(SAMPLED).collect()
        if rows:
            own = choose_centers(np.array([r["embedding"] for r in rows], np.float64), min(MOST_CELLS, -(-n // CELL_VECTORS)))
            centers[dim] = np.arange(first, first + len(own), dtype=np.int64), own
            first += len(own)
    total = sum(counts.values())
    parts = max(1, -(-total // (max(first - base, 1) * FILE_VECTORS)))
    placed = vectors.select("chunk_id", "embedding").mapInArrow(_placed(centers), SCHEMA)
    dealt = placed.repartition("cell") if parts == 1 else placed.repartition(min(max(first - base, 1) * parts, 100_000), "cell", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)))
    dealt.sortWithinPartitions("cell", "gap").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
    measured = {r["cell"]: (r["radius"], r["n"]) for r in spark.read.schema(SCHEMA).parquet(f"{folder}/rows").groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()}
    rows = [(int(c), own.tolist(), *measured[int(c)]) for cells, centers_ in centers.values() for c, own in zip(cells, centers_, strict=True) if int(c) in measured]
    rows += [(LOOSE, [], float("inf"), measured[LOOSE][1])] if LOOSE in measured else []
    spark.createDataFrame(rows, "cell long, center array<double>, radius double, size long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")


def open_cells(spark: SparkSession, folders: list[str]) -> VectorCells:
    """The cells under all folders, together; each folder's are numbered apart, and loose ones are one cell."""
    plain_unions(spark)
    known: dict[int, tuple] = {}
    for f in folders:  # at most MOST_CELLS for each length of vectors
        for r in spark.read.schema("cell long, center array<double>, radius double, size long").parquet(f"{f}/cells").toArrow().to_pylist():
            size = r["size"] + (known[r["cell"]][3] if r["cell"] in known else 0)
            known[r["cell"]] = r["cell"], tuple(r["center"]), r["radius"], size
    rows = reduce(DataFrame.unionByName, [spark.read.schema(SCHEMA).parquet(f"{f}/rows") for f in folders])
    return VectorCells(rows, tuple(known.values()))
