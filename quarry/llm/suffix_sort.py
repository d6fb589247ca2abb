"""Suffix sort by hash comparison: prefix hashes and binary search give common extensions, a merge sort orders the suffixes (numpy)."""

from __future__ import annotations

import numpy as np

from quarry.llm.hashing import Polynomial


class Suffixes:
    """Suffixes of a buffer, each read for at most `width` bytes, which must lie in the buffer."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width = data, width
        self.hasher = Polynomial(1)
        self.prefix = self.hasher.prefix(data)
        self.inverse = self.hasher.powers(len(data) + 1)[1]

    def _same(self, x: np.ndarray, y: np.ndarray, n) -> np.ndarray:
        return (self.prefix[x + n] - self.prefix[x]) * self.inverse[x] == (self.prefix[y + n] - self.prefix[y]) * self.inverse[y]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The length of the common extension of the suffixes at x and y, at most width: a binary search over hash equality."""
        low = np.where(self._same(x, y, self.width), self.width, 0)
        left = np.flatnonzero(low == 0)
        if len(left):
            p, q = x[left], y[left]
            a, b = np.zeros(len(left), np.int64), np.full(len(left), self.width - 1)
            while (a < b).any():
                mid = (a + b + 1) >> 1
                same = self._same(p, q, mid)
                a, b = np.where(same, mid, a), np.where(same, b, mid - 1)
            low[left] = a
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x sorts before y, x and y agree over the whole width)."""
        n = self.common(x, y)
        equal = n >= self.width
        at = np.minimum(n, self.width - 1)
        return self.data[x + at] < self.data[y + at], equal

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Indexes that order the suffixes `at` by segment, then by their bytes; equal ones keep their order.

        A bottom-up merge sort of all segments at once. In each round every element finds its place in the run beside its own by
        binary search, so a round takes log(run) comparisons an element and a comparison takes log(width) hash equalities.
        """
        order = np.argsort(segment, kind="stable")
        seg = segment[order]
        start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(seg)))
        base, limit = np.repeat(start, size), np.repeat(start + size, size)
        place, run = np.arange(len(seg)), 1
        live = np.flatnonzero(limit - base > 1)
        while len(live):
            b, e = base[live], limit[live]
            pair = b + (live - b) // (2 * run) * (2 * run)
            middle = np.minimum(pair + run, e)
            mine = live < middle
            low = np.where(mine, middle, pair)
            first = low.copy()
            high = np.where(mine, np.minimum(pair + 2 * run, e), middle)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                x, y = at[order[live[open_]]], at[order[mid]]
                less, equal = self.before(y, x)
                less |= equal & ~mine[open_]  # of equals the left run's come first
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            own = live - np.where(mine, pair, middle)
            place[live] = pair + own + low - first
            new = order.copy()
            new[place[live]] = order[live]
            order = new
            run *= 2
            live = live[(limit - base)[live] > run]
        return order

    def classes(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """A class number for each suffix: equal for equal segments and bytes. Equal hashes are verified against the bytes."""
        order = self.sort(at, segment)
        same = np.zeros(len(at), bool)
        x, y = at[order[:-1]], at[order[1:]]
        if len(at) > 1:
            same[1:] = (segment[order[1:]] == segment[order[:-1]]) & self._same(x, y, self.width)
        claim = np.flatnonzero(same)
        reach = np.arange(self.width)
        for low in range(0, len(claim), 1 << 15):
            part = claim[low : low + (1 << 15)]
            wrong = (self.data[at[order[part]][:, None] + reach] != self.data[at[order[part - 1]][:, None] + reach]).any(1)
            same[part[wrong]] = False
        out = np.empty(len(at), np.int64)
        out[order] = np.cumsum(~same)
        return out
