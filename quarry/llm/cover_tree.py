"""Cover trees of unit vectors and their dual traversal (numpy, no Spark)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Radii of the levels below the root; each half the one above.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Distances come from dot products of unit vectors; near 0 they are off by about 1e-7.
_SLACK = 1e-6
#: Pairs whose distances are taken together.
_PAIRS = 1 << 15


@dataclass
class Level:
    """Nodes of one level. Members of node i are order[start[i] : start[i + 1]]; its children are the next level's nodes first[i] to first[i + 1]."""

    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    first: np.ndarray | None = None


class CoverTree:
    """Nested levels of centers over rows of x. Every member lies within its node's radius of the node's center; radii are those measured."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.levels = [self._level([(0, len(x), 0)])]
        for r in RADII:
            self._refine(r)
        points = Level(self.order.copy(), np.zeros(len(x)), np.arange(len(x) + 1))
        self.levels[-1].first = self.levels[-1].start.copy()
        self.levels.append(points)

    def _level(self, nodes: list[tuple[int, int, int]]) -> Level:
        start = np.array([n[0] for n in nodes] + [len(self.x)], np.int64)
        center = self.order[start[:-1]]
        radius = np.zeros(len(nodes))
        for i in np.flatnonzero(np.diff(start) > 1):
            radius[i] = np.linalg.norm(self.x[self.order[start[i] : start[i + 1]]] - self.x[center[i]], axis=1).max()
        return Level(center, radius, start)

    def _refine(self, r: float) -> None:
        above = self.levels[-1]
        nodes, first = [], [0]
        for i in range(len(above.center)):
            a, b = int(above.start[i]), int(above.start[i + 1])
            if b - a == 1 or above.radius[i] <= r:
                nodes.append((a, b, 0))
            else:
                rest, done = self.order[a:b].copy(), []
                while len(rest):  # the first of the rest becomes a center and takes what it covers
                    near = self.x[rest] @ self.x[rest[0]] >= 1 - r * r / 2
                    near[0] = True
                    done.append(rest[near])
                    rest = rest[~near]
                at = a
                for d in done:
                    nodes.append((at, at + len(d), 0))
                    at += len(d)
                self.order[a:b] = np.concatenate(done)
            first.append(len(nodes))
        above.first = np.array(first)
        self.levels.append(self._level(nodes))


def _children(i: np.ndarray, j: np.ndarray, fi: np.ndarray, fj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of i and a child of j."""
    ni, nj = fi[i + 1] - fi[i], fj[j + 1] - fj[j]
    n = ni * nj
    row = np.repeat(np.arange(len(i)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return fi[i][row] + k // nj[row], fj[j][row] + k % nj[row]


def threshold_pairs(a: CoverTree, b: CoverTree, cosine: float):
    """Yields exact results of a dual traversal over unit vectors: ("point", p, q) arrays of rows of a and b with a cosine >= the threshold,
    and ("node", members of a, members of b) for node pairs all of whose pairs are linked. With a is b, each unordered pair comes once
    (p < q by place), and a node met with itself comes as equal member arrays.
    """
    reach, same = np.sqrt(max(0.0, 2 - 2 * cosine)), a is b
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero)]
    while stack:
        depth, i, j = stack.pop()
        la, lb = a.levels[depth], b.levels[depth]
        if depth == len(a.levels) - 1:
            p, q = la.center[i], lb.center[j]
            if same:
                p, q = p[i < j], q[i < j]
            good = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= cosine
            if good.any():
                yield "point", p[good], q[good]
            continue
        d = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", a.x[la.center[i]], b.x[lb.center[j]])))
        within = (d + la.radius[i] + lb.radius[j] <= reach - _SLACK) & ((np.diff(la.start)[i] > 1) | (np.diff(lb.start)[j] > 1))
        for m, n in zip(i[within].tolist(), j[within].tolist(), strict=True):
            yield "node", a.order[la.start[m] : la.start[m + 1]], b.order[lb.start[n] : lb.start[n + 1]]
        i, j = i[~within], j[~within]
        size = (la.first[i + 1] - la.first[i]) * (lb.first[j + 1] - lb.first[j])
        below = a.levels[depth + 1], b.levels[depth + 1]
        for m, n in zip(i[size > _PAIRS].tolist(), j[size > _PAIRS].tolist(), strict=True):  # a product of matrices for two large families
            cj = np.arange(lb.first[n], lb.first[n + 1])
            step = max(1, _PAIRS * 8 // len(cj))
            for low in range(int(la.first[m]), int(la.first[m + 1]), step):
                ci = np.arange(low, min(low + step, int(la.first[m + 1])))
                d2 = 2 - 2 * a.x[below[0].center[ci]] @ b.x[below[1].center[cj]].T
                bound = reach + _SLACK + below[0].radius[ci][:, None] + below[1].radius[cj][None, :]
                keep = d2 <= bound * bound
                if same:
                    keep &= ci[:, None] <= cj[None, :]
                x, y = np.nonzero(keep)
                stack += [(depth + 1, ci[x[k : k + _PAIRS]], cj[y[k : k + _PAIRS]]) for k in range(0, len(x), _PAIRS)]
        i, j, size = i[size <= _PAIRS], j[size <= _PAIRS], size[size <= _PAIRS]
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // _PAIRS)) + 1
        for x, y in zip(np.split(i, cuts), np.split(j, cuts), strict=True):
            if len(x):
                ci, cj = _children(x, y, la.first, lb.first)
                d2 = 2 - 2 * np.einsum("ij,ij->i", a.x[below[0].center[ci]], b.x[below[1].center[cj]])
                bound = reach + _SLACK + below[0].radius[ci] + below[1].radius[cj]
                keep = d2 <= bound * bound
                if same:
                    keep &= ci <= cj
                if keep.any():
                    stack.append((depth + 1, ci[keep], cj[keep]))
