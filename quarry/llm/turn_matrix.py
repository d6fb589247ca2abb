"""Min-plus matrices of conversation turns (plain Python, no Spark).

Roles have to read (s?(ua)+)?: nothing, or pairs of user and assistant with one system turn before them at most. That is an automaton of four
states: nothing yet, after s, after u, after a; the first and the last may end. A turn is a 4x4 matrix whose entry (i, j) holds the cheapest
edits that lead from i to j, as (cost, audit) with equal costs decided by the audit in ASCII order. Inserts after the turn are already in it.
Two paths of equal cost over the same turns are never one a prefix of the other, as each further letter is an insert and costs, so the order
of audits survives concatenation and the product of matrices is associative.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
Entry = tuple[int, str] | None
Matrix = tuple[tuple[Entry, ...], ...]
#: state -> {initial: state}; the states that may end.
STEPS: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ONE: Matrix = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))


def product(left: Matrix, right: Matrix) -> Matrix:
    return tuple(apply(row, right) for row in left)


def apply(row: tuple[Entry, ...], matrix: Matrix) -> tuple[Entry, ...]:
    """A row of a matrix times a matrix."""
    out: list[Entry] = [None] * 4
    for first, entries in zip(row, matrix, strict=True):
        if first is not None:
            for j, then in enumerate(entries):
                if then is not None:
                    cost = first[0] + then[0]
                    if out[j] is None or cost < out[j][0] or (cost == out[j][0] and first[1] + then[1] < out[j][1]):
                        out[j] = cost, first[1] + then[1]
    return tuple(out)


def _closure() -> Matrix:
    """The cheapest inserts from each state to each other: no path of inserts needs more than the four states."""
    step: list[list[Entry]] = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i, steps in enumerate(STEPS):
        for c in "ua":
            if c in steps:
                step[i][steps[c]] = INSERT, "I"
    once: Matrix = tuple(map(tuple, step))
    out = once
    for _ in range(2):
        out = product(out, out)
    return out


CLOSED = _closure()


@lru_cache(maxsize=64)
def turn(kind: str) -> Matrix:
    """The matrix of a turn by its kind: the role's initial (s, u, a, or ? for any other) and what is wrong with it: - nothing, t truncated, x to be deleted."""
    role, fault = kind
    rows: list[list[Entry]] = [[None] * 4 for _ in range(4)]

    def put(i: int, j: int, entry: tuple[int, str]) -> None:
        rows[i][j] = entry if rows[i][j] is None else min(rows[i][j], entry)

    more = TRUNCATED if fault == "t" else 0
    for i, steps in enumerate(STEPS):
        put(i, i, (DELETE, "D"))
        if fault != "x":
            if role in steps:
                put(i, steps[role], (more, "K"))
            for c in "ua":
                if c in steps:
                    put(i, steps[c], (RETYPE + more, "R"))
    return product(tuple(map(tuple, rows)), CLOSED)


def matrix_of(kinds: Iterable[str]) -> Matrix:
    """The product of the turns' matrices; inserts before the first turn are left to ends()."""
    out = ONE
    for k in kinds:
        out = product(out, turn(k))
    return out


def ends(row: tuple[Entry, ...]) -> tuple[int, str]:
    """The cheapest edits of a whole conversation by its first row, with the inserts before its first turn already in it."""
    return min(row[j] for j in FINAL if row[j] is not None)


@lru_cache(maxsize=1 << 14)
def repaired(kinds: tuple[str, ...]) -> tuple[int, str]:
    """(cost, audit) of a whole short conversation."""
    row = CLOSED[0]
    for k in kinds:
        row = apply(row, turn(k))
    return ends(row)


@dataclass
class Roles:
    """Walks an audit along a conversation's turns and says which lines the repaired one has, holding only its place and its state."""

    audit: str
    at: int = 0
    state: int = 0

    def _fill(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = 3 if self.state == 2 else 2
        return role

    def inserts(self) -> list[str]:
        """The lines inserted at this place."""
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            out.append(f"{self._fill()}:")
            self.at += 1
        return out

    def lines(self, role: str, text: str) -> list[str]:
        """The lines for the next turn, with inserts before it."""
        out = self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[self.state][role[:1]]
            out.append(f"{role}:{text}")
        elif edit == "R":
            out.append(f"{self._fill()}:{text}")
        return out
