"""Prefix polynomial hashes over byte buffers, and word hashes cut from them (numpy, no Spark).

All hashes are polynomials over the integers modulo 2**64 with an odd base, so a prefix sum and a power of the base's
inverse give the hash of any substring in constant time.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Texts are joined into buffers of about this many bytes, so that the working arrays stay small.
BUFFER_BYTES = 1 << 18


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of each element."""
    x = (x + U64(0x9E3779B97F4A7C15)).astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Polynomial:
    """Substring hashes of a byte buffer. Equal substrings have equal hashes wherever they start."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, seed: int = 0):
        self.seed = seed
        self.base = BASES[seed]
        self.table = splitmix(np.arange(256, dtype=U64) + U64(1 + 1000 * seed))

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The base's first n powers and those of its inverse, kept between calls and grown when needed."""
        have = self._powers.get(self.seed)
        if have is None or len(have[0]) < n:
            size = max(n, BUFFER_BYTES + 4096)
            with np.errstate(over="ignore"):
                have = tuple(np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]), dtype=U64) for b in (self.base, pow(self.base, -1, 1 << 64)))
            self._powers[self.seed] = have
        return have[0][:n], have[1][:n]

    @classmethod
    def forget(cls) -> None:
        """Frees the kept powers; a worker that waits for its next task doesn't need them."""
        cls._powers.clear()

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """P with P[j] - P[i] = base**i times the hash of data[i:j]."""
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * self.powers(len(data))[0], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of data[start:end], element by element."""
        return (prefix[end] - prefix[start]) * self.powers(len(prefix))[1][start]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """The hash of every window of the given width."""
        return (prefix[width:] - prefix[:-width]) * self.powers(len(prefix))[1][: len(prefix) - width]


def joined(texts, limit: int = BUFFER_BYTES):
    """Yields (first, last, buffer, offsets): texts[first:last] as UTF-8 joined by a newline, and where each one starts.

    offsets has one more entry than there are texts; text k is buffer[offsets[k] : offsets[k + 1] - 1]. A text over the limit
    gets a buffer of its own. None counts as empty.
    """
    first, parts, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else (text or b"")
        if parts and size + len(raw) > limit:
            yield first, k, *_packed(parts)
            first, parts, size = k, [], 0
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        yield first, first + len(parts), *_packed(parts)


def _packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), offsets


#: White space of words: space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: For words of letters and digits: every ASCII byte that is neither, beside white space.
NO_LETTER = np.ones(256, bool)
NO_LETTER[128:] = NO_LETTER[48:58] = NO_LETTER[65:91] = NO_LETTER[97:123] = False


def words(data: np.ndarray, offsets: np.ndarray, hasher: Polynomial, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the mixed 64-bit hash of every word in the buffer, A-Z lower-cased, and the number of words of each text."""
    data = _LOWER[data]
    inside = np.concatenate([[False], ~between[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    hashes = splitmix(hasher.spans(hasher.prefix(data), start, end) ^ (end - start).astype(U64))
    bounds = np.searchsorted(start, offsets)
    return hashes, np.diff(bounds)


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text): every run of n words, as a mixed hash, and the index of its text. Shorter texts count as one run, empty ones have none."""
    with np.errstate(over="ignore"):
        ends = np.cumsum(counts)
        text = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(hashes))
        whole = at + n <= ends[text] if len(hashes) else np.zeros(0, bool)
        full = at[whole]
        acc = np.zeros(len(full), U64)
        for k in range(n):
            acc = splitmix(acc * U64(3) + hashes[full + k])
        short = np.flatnonzero((counts > 0) & (counts < n))
        out = [acc]
        if len(short):
            few = np.zeros(len(short), U64)
            for k in range(n - 1):
                live = counts[short] > k
                few[live] = splitmix(few[live] * U64(3) + hashes[(ends[short] - counts[short])[live] + k])
            out.append(splitmix(few + U64(7)))
        return np.concatenate(out), np.concatenate([text[whole], short])
