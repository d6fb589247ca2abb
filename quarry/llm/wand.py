"""Top-k by WAND over the inverted lists of one shard of documents (numpy, no Spark).

A shard's lists hold places of documents in ascending order with the impact of each posting. All cursors of a query go through the shard
window by window. In a window the largest impacts of the terms that stand at a document are added up; a document where they reach what the
heap asks for is a pivot. Only pivots are scored, and where all terms of a window together stay below, every cursor skips it.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Documents of a window.
WINDOW = 2048


class Heap:
    """The k best (score, id) of a query: higher scores first, then smaller ids, missing ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """The smallest score that may still enter; an equal one may, by its id."""
        return self.rows[0][0] if len(self.rows) == self.k else 1

    def offer(self, score: int, doc: int | None) -> None:
        row = (score, 0, 0) if doc is None else (score, 1, -doc)
        if len(self.rows) < self.k:
            heapq.heappush(self.rows, row)
        elif row > self.rows[0]:
            heapq.heapreplace(self.rows, row)

    def best(self) -> list[tuple[int, int | None]]:
        return [(score, -neg if known else None) for score, known, neg in sorted(self.rows, reverse=True)]


class Shard:
    """Inverted lists of a block of documents: for each term its documents' places, its impacts, and the largest of them."""

    def __init__(self, ids: list[int | None], row: np.ndarray, term: np.ndarray, impact: np.ndarray, window: int = WINDOW):
        self.ids, self.window = ids, window
        order = np.lexsort((row, term))
        self.row, term, self.impact = row[order], term[order], impact[order].astype(np.float64)  # whole numbers far below 2 ** 53
        self.start = np.flatnonzero(np.diff(term, prepend=-1))
        self.end = np.append(self.start[1:], len(term))
        self.at = {int(t): k for k, t in enumerate(term[self.start])}
        self.most = np.maximum.reduceat(self.impact, self.start) if len(term) else np.zeros(0)
        self.edges = np.arange(0, len(ids) + window, window)
        self.cuts: dict[int, np.ndarray] = {}
        self.looked = 0  # pivots

    def _cut(self, k: int) -> np.ndarray:
        """Where each window begins in a list."""
        if k not in self.cuts:
            self.cuts[k] = self.start[k] + np.searchsorted(self.row[self.start[k] : self.end[k]], self.edges)
        return self.cuts[k]

    def search(self, terms: list[int], heap: Heap) -> None:
        """Offers the heap every document of the shard that may enter it."""
        lists = [k for t in terms if (k := self.at.get(t)) is not None]
        if not lists or self.most[lists].sum() < heap.least:
            return
        cuts, most = np.array([self._cut(k) for k in lists]), self.most[lists]
        reach = most @ (cuts[:, 1:] > cuts[:, :-1])
        for w in np.argsort(-reach, kind="stable"):
            least = heap.least
            if reach[w] < least:
                return
            low, high = cuts[:, w], cuts[:, w + 1]
            at = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b])
            row = self.row[at] - w * self.window
            pivot = np.bincount(row, weights=np.repeat(most, high - low), minlength=self.window) >= least
            own = pivot[row]
            score = np.bincount(row[own], weights=self.impact[at[own]], minlength=self.window)
            self.looked += int(pivot.sum())
            good = np.flatnonzero(pivot & (score >= least))
            if len(good) > heap.k:  # all that equal the k-th best of them stay
                good = good[score[good] >= np.partition(score[good], len(good) - heap.k)[len(good) - heap.k]]
            for d in good.tolist():
                heap.offer(int(score[d]), self.ids[w * self.window + d])
