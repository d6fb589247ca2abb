"""Content-chosen anchors of fixed-length windows in byte strings (numpy, no Spark)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from quarry.llm.hashing import U64, Polynomial, splitmix


class Runs(NamedTuple):
    """Runs of consecutive windows with the same anchor. start and last are places in the buffer where windows start."""

    text: np.ndarray
    start: np.ndarray
    last: np.ndarray
    anchor: np.ndarray


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])
    return out


def anchor_runs(prefix: np.ndarray, offsets: np.ndarray, hasher: Polynomial, window: int, gram: int) -> Runs:
    """Every window of `window` bytes that lies in one text, as runs that share an anchor.

    A window's anchor is the place of its least-hashed gram of `gram` bytes, the leftmost of equals. It depends on the window's
    bytes alone, so equal windows have their anchors at equal distances.
    """
    size = len(prefix) - 1
    empty = np.zeros(0, np.int64)
    if size < window:
        return Runs(empty, empty, empty, empty)
    grams = splitmix(hasher.windows(prefix, gram))
    packed = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    anchor = (sliding_min(packed, window - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for end in offsets[1:].tolist():  # the last byte of each text's part of the buffer is a separator
        valid[max(0, end - window) : end] = False
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(change)
    last = np.append(start[1:], len(anchor)) - 1
    live = valid[start]
    start, last = start[live], last[live]
    return Runs(np.searchsorted(offsets, start, side="right") - 1, start, last, anchor[start])
