"""Phrases in the stored text index: which rows of it a set of phrases needs, where they stand in a block, and what a block can score at most."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.model import TextIndex
from quarry.sources.postings import HEADS, bucket_of, unpacked

#: Trigrams that a scan filters by as a list of values; more are joined as a broadcast table.
LISTED = 1000


def grams_of(phrase: str) -> list[tuple[str, int]]:
    """Every trigram of a phrase with its offset."""
    return [(phrase[k : k + 3], k) for k in range(len(phrase) - 2)]


def needed(text: TextIndex, terms: list[str]) -> DataFrame:
    """The rows of the index that the phrases need, block by block: only the buckets of their trigrams, and each block's head first."""
    grams = sorted({g for t in terms for g, _ in grams_of(t)})
    buckets = sorted({bucket_of(g, text.buckets) for g in grams})
    rows = text.rows.where(F.col("bucket").isin([HEADS, *buckets]))
    if len(grams) <= LISTED:
        rows = rows.where(F.col("gram").isin(["", *grams]))
    else:
        wanted = rows.sparkSession.createDataFrame([("",), *((g,) for g in grams)], "gram string")  # bounded by a block of queries
        rows = rows.join(F.broadcast(wanted), "gram", "left_semi")
    return rows.repartition("block").sortWithinPartitions("block", "gram").select("block", "gram", "most", "least", "coords", "ids", "starts", "lengths")


@dataclass
class Block:
    """A block's chunks, and the rows of the trigrams that were asked for."""

    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    live: np.ndarray | None = None  # which chunks are, if not all
    rows: dict[str, tuple[list[int], int, bytes]] = field(default_factory=dict)
    _coords: dict[str, np.ndarray] = field(default_factory=dict)

    def _places(self, gram: str) -> np.ndarray:
        if gram not in self._coords:
            self._coords[gram] = unpacked(self.rows[gram][2])
        return self._coords[gram]

    def holds(self, grams: list[tuple[str, int]]) -> bool:
        return all(g in self.rows for g, _ in grams)

    def places(self, grams: list[tuple[str, int]]) -> np.ndarray:
        """Where a phrase stands: the places of its rarest trigram that all others confirm."""
        if not self.holds(grams):
            return np.zeros(0, np.int64)
        order = sorted(grams, key=lambda g: len(self.rows[g[0]][2]))
        at = self._places(order[0][0]) - order[0][1]
        for gram, offset in order[1:]:
            if not len(at):
                break
            known = self._places(gram)
            where = np.minimum(np.searchsorted(known, at + offset), len(known) - 1)
            at = at[known[where] == at + offset]
        return at

    def hits(self, terms: list[list[tuple[str, int]]], some: list[int]) -> np.ndarray:
        """Rows (chunk's place in the block, term, occurrences in heading, context and content) of some of the terms."""
        out = [np.zeros((0, 5), np.int64)]
        for t in some:
            at = self.places(terms[t])
            if len(at):
                own = np.searchsorted(self.starts, at, "right") - 1
                rows, number = np.unique(own // 3, return_inverse=True)
                counts = np.bincount(number * 3 + own % 3, minlength=3 * len(rows)).reshape(-1, 3)
                out.append(np.concatenate([rows[:, None], np.full((len(rows), 1), t), counts], 1))
        found = np.concatenate(out)
        found = found if self.live is None else found[self.live[found[:, 0]]]
        return found[np.argsort(found[:, 0], kind="stable")]

    def most(self, grams: list[tuple[str, int]]) -> tuple[np.ndarray, int] | None:
        """(most occurrences in each field, least length) that a chunk with the phrase can have; None where there is none."""
        if not self.holds(grams):
            return None
        rows = [self.rows[g] for g, _ in grams]
        return np.min([r[0] for r in rows], axis=0), max(r[1] for r in rows)


def blocks_of(batches: Iterator[pa.RecordBatch], dead: np.ndarray, stride: int) -> Iterator[Block]:
    """Blocks from rows of needed(). A block without any of the trigrams is left out; chunks of dead serials are never found."""
    block, number = None, None
    for batch in batches:
        for k, (at, gram) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if at != number:
                if block is not None and block.rows:
                    yield block
                block, number = None, at
            if gram == "" and batch.column(5)[k].is_valid:
                ids = np.asarray(batch.column(5)[k].values)
                block = Block(ids, *(np.frombuffer(batch.column(c)[k].as_py(), "<i8") for c in (6, 7)), ~np.isin(ids // stride, dead) if len(dead) else None)
            elif block is not None:
                block.rows[gram] = batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
    if block is not None and block.rows:
        yield block
