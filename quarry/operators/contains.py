"""A contains-join: which needles stand in which texts, where both are tables of any size.

Texts and needles are thinned to the same seeds: of every run of WINDOW consecutive grams of GRAM characters the one of least hash. A needle
that stands in a text has each of its own runs there, so any one of its seeds is among the text's; the one that is rarest in the corpus is
its key. Needles meet texts by an equi-join on it, and each meeting is verified character by character at the place that the seed tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import durable, hinted

#: Characters of a gram, and grams of a run: a needle has to hold one run.
GRAM, WINDOW = 6, 7
SHORTEST = GRAM + WINDOW - 1


def _minimizers(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the seeds of texts that lie one after another. ends: for each character where its text ends."""
    n = len(points) - SHORTEST + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(points) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(h)] + np.uint64(1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    least, at = h[:n].copy(), np.arange(n)
    for k in range(1, WINDOW):
        lower = h[k : k + n] < least  # of equal ones the first
        least, at = np.where(lower, h[k : k + n], least), np.where(lower, np.arange(k, k + n), at)
    at = np.unique(at[np.arange(n) + SHORTEST <= ends[:n]])  # a run lies in one text
    return h[at].view(np.int64), at


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def minimizers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a text's seeds; none in a text under SHORTEST characters."""
    points = _points(text)
    h, at = _minimizers(points, np.full(len(points), len(points)))
    return h, at.astype(np.int32)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            texts = [t or "" for t in part.column(1).to_pylist()]
            size = np.array([len(t) for t in texts], np.int64)
            start, own = np.cumsum(size) - size, np.repeat(np.arange(len(texts)), size)
            h, at = _minimizers(_points("".join(texts)), (start + size)[own])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own[at])), pa.array(h), pa.array((at - start[own[at]]).astype(np.int32))], names=["id", "seed", "at"])


def seeds(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, seed, at): the seeds of each text. A seed that stands twice is two rows."""
    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_seeds, "id long, seed long, at int")


def occurrences(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text_id, needle_id, start, end): every place where a needle (needle_id, needle) stands in a text (text_id, text), overlapping ones too.

    Ids are unique longs. Needles have SHORTEST characters or more; shorter ones are never found. Both tables are read more than once.
    """
    of_needles = seeds(needles, "needle_id", "needle").select(F.col("id").alias("needle_id"), "seed", F.col("at").alias("offset"))
    wanted = durable(of_needles, "needle-seeds")
    # no other seed of a text is ever asked for
    own = durable(seeds(texts, "text_id", "text").join(hinted(wanted.select("seed").distinct()), "seed", "left_semi"), "seeds")
    counts = own.groupBy("seed").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("needle_id").orderBy("n", "seed", "offset")
    # a needle one of whose seeds stands nowhere is in no text
    keyed = wanted.join(counts, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(rarest)).where("r = 1 and n > 0")
    keyed = durable(keyed.join(needles, "needle_id").select("needle_id", "seed", "offset", "needle", F.length("needle").alias("size")), "keys")
    met = own.join(keyed, "seed").withColumn("start", F.col("at") - F.col("offset")).where("start >= 0").select(F.col("id").alias("text_id"), "needle_id", "needle", "start", "size")
    same = met.join(texts, "text_id").where(F.expr("substring(text, start + 1, size)") == F.col("needle"))
    return same.select("text_id", "needle_id", "start", (F.col("start") + F.col("size")).alias("end"))


def outermost(found: DataFrame) -> DataFrame:
    """Adds inner to occurrences: whether one lies within that of another needle. Needles are distinct, so equal intervals are one needle's."""
    before = Window.partitionBy("text_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("inner", F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False)))
