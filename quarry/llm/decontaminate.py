"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased. Items and documents meet by shared seeds of five words.
For each meeting the longest common runs of words that do not overlap others are marked again and again, found by a running Karp-Rabin
search, and the share of the item's words under marks is its coverage. Reordered passages keep their coverage, as tiles may lie in any order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.durable import as_id, durable, release_memory, small_batches
from quarry.llm.hashing import NO_LETTER, U64, Polynomial, joined, splitmix, words

SEED_WORDS, COVERAGE = 5, 0.8
#: Item text that one pass over the documents takes along; more items make more passes.
BLOCK_BYTES = 8 << 20
#: Blocks after which the passes so far are written, so that the driver holds the items of no more than these.
HELD_BLOCKS = 8


def _lower(text: str | None) -> str:
    return (text or "").lower()


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    hasher, out = Polynomial(0), []
    for _, _, data, offsets in joined([_lower(t) for t in texts]):
        h, n = words(data, offsets, hasher, NO_LETTER)
        out += np.split(h, np.cumsum(n)[:-1])
    return out


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """The Karp-Rabin value of every run of n words. It runs on from word to word: a prefix sum gives each in constant time."""
    power, inverse = Polynomial(0).powers(len(h) + 1)
    prefix = np.zeros(len(h) + 1, U64)
    np.cumsum(h * power[: len(h)], out=prefix[1:])
    size = max(0, len(h) - n + 1)
    return splitmix((prefix[n : n + size] - prefix[:size]) * inverse[:size])


def _matches(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, s: int) -> np.ndarray:
    """Maximal unmarked matches, rows (length, place in item, place in doc), of at least s words, from seeds with equal Karp-Rabin values.

    Seeds that follow equal unmarked words are parts of longer matches and are never paired, so that repeated words don't meet each with each.
    """
    none = np.zeros((0, 3), np.int64)
    if min(len(item), len(doc)) < s:
        return none
    gi, gd = _grams(item, s), _grams(doc, s)
    at_i, at_d = np.flatnonzero(_runs(free_i, s)), np.flatnonzero(_runs(free_d, s))
    at_d = at_d[np.isin(gd[at_d], gi[at_i])]
    if not len(at_i) or not len(at_d):
        return none
    before = lambda h, free, at: np.where((at > 0) & (free[at - 1] > 0), splitmix(h[at - 1]) | U64(1), U64(0))
    pi, pd = before(item, free_i, at_i), before(doc, free_d, at_d)
    order = np.lexsort((pd, gd[at_d]))
    at_d, pd = at_d[order], pd[order]
    grams = gd[at_d]
    low, high = np.searchsorted(grams, gi[at_i]), np.searchsorted(grams, gi[at_i], side="right")
    left, right = [], []
    for i, p, a, b in zip(at_i.tolist(), pi, low.tolist(), high.tolist(), strict=True):
        if a < b:
            x, y = (a, a) if p == 0 else a + np.searchsorted(pd[a:b], np.array([p, p + U64(1)]))
            for d in (at_d[a:x], at_d[y:b]):
                left.append(np.full(len(d), i))
                right.append(d)
    i, d = (np.concatenate(left), np.concatenate(right)) if left else (none[:, 0], none[:, 0])
    i_end, d_end = np.append(free_i > 0, False), np.append(free_d > 0, False)
    item_, doc_ = np.append(item, U64(0)), np.append(doc, U64(0))
    same = np.ones(len(i), bool)
    for k in range(s):  # equal values are verified word by word
        same &= item[i + k] == doc[d + k]
    i, d = i[same], d[same]
    n, live = np.full(len(i), s), np.arange(len(i))
    while len(live):
        x, y = i[live] + n[live], d[live] + n[live]
        live = live[i_end[x] & d_end[y] & (item_[x] == doc_[y])]
        n[live] += 1
    return np.stack([n, i, d], 1)


def _runs(free: np.ndarray, s: int) -> np.ndarray:
    """Whether s unmarked words start at each place."""
    total = np.concatenate([[0], np.cumsum(free)])
    return total[s:] - total[:-s] == s


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (length, place in item, place in doc): again and again the longest match of unmarked words, the first in item and doc among equals."""
    free_i, free_d, out = np.ones(len(item), np.int64), np.ones(len(doc), np.int64), []
    s = max(least, 20)
    while True:
        found = _matches(item, doc, free_i, free_d, s)
        longest = int(found[:, 0].max()) if len(found) else 0
        if longest > 2 * s:
            s = longest
            continue
        while len(found):  # all matches of s words or more, longest first; what is left of a part that was covered comes again
            found = found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))]
            n, i, d = found[0].tolist()
            free_i[i : i + n] = free_d[d : d + n] = 0
            out.append((n, i, d))
            ti, td = np.concatenate([[0], np.cumsum(free_i)]), np.concatenate([[0], np.cumsum(free_d)])
            m, x, y = found.T
            clear = found[(ti[x + m] - ti[x] == m) & (td[y + m] - td[y] == m)]
            found = clear if len(clear) and clear[0, 0] == n else _matches(item, doc, free_i, free_d, s)
        if s == least:
            return out
        s = max(least, s // 2)


class Index:
    """Seeds of a bounded block of items."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.ids = [i for i, _ in items]
        self.words = word_hashes([t for _, t in items])
        self.least = [min(least, len(w)) for w in self.words]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted(set(self.least) - {0}):
            own = [k for k, x in enumerate(self.least) if x == n]
            grams = np.concatenate([_grams(self.words[k], n) for k in own])
            item = np.repeat(own, [len(self.words[k]) - n + 1 for k in own])
            order = np.argsort(grams, kind="stable")
            self.seeds[n] = grams[order], item[order]

    def met(self, h: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item id, coverage) of the items that reach the threshold in a document."""
        shared: dict[int, list[np.ndarray]] = defaultdict(list)
        for n, (grams, item) in self.seeds.items():
            own = _grams(h, n)
            at = np.searchsorted(grams, own)
            own = np.unique(own[grams[np.minimum(at, len(grams) - 1)] == own])
            low, high = np.searchsorted(grams, own), np.searchsorted(grams, own, side="right")
            for a, b, g in zip(low.tolist(), high.tolist(), own.tolist(), strict=True):
                for k in set(item[a:b].tolist()):
                    shared[k].append(g)
        out = []
        for k, g in shared.items():
            w, n = self.words[k], self.least[k]
            seed = np.isin(_grams(w, n), np.array(g, U64))
            most = np.convolve(seed, np.ones(n, np.int64)) > 0  # words that any tile could cover
            if most.sum() >= threshold * len(w):
                cover = sum(t[0] for t in tiles(w, h, n)) / len(w)
                if cover >= threshold:
                    out.append((self.ids[k], cover))
        return sorted(out)


def _checker(items: list[tuple[int, str]], least: int, threshold: float):
    kept: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Index(items, least))
        for batch in batches:
            found = []
            texts = batch.column(0).to_pylist()
            for low in range(0, len(texts), 256):
                found += [kept[0].met(h, threshold) for h in word_hashes(texts[low : low + 256])]
            ids = pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64()))
            cover = pa.array([max((c for _, c in f), default=0.0) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids, cover], names=[*batch.schema.names[1:], "items_new", "cover_new"])
            del texts, found
            release_memory()
        Polynomial.forget()
        release_memory()

    return run


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = SEED_WORDS, threshold: float = COVERAGE) -> DataFrame:
    """docs with item_ids (sorted ids of the items whose coverage reaches the threshold), coverage (the largest, else 0) and contaminated added.

    Columns of docs with these names are replaced. Null and empty texts meet nothing; items without id or without words are left out.
    An item of fewer words than a seed is its own seed. Items that repeat an id are reported once. Every text is read whole.
    """
    small_batches(docs.sparkSession)
    added = ["item_ids", "coverage", "contaminated"]
    names = [c for c in docs.columns if c not in added]
    kinds = dict(docs.dtypes)
    items = benchmark.select(as_id(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    out = docs.select(F.col(text_col).cast("string").alias("read"), *(F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(names)), F.array().cast("array<long>").alias("ids"), F.lit(0.0).alias("cover"))
    base = ", ".join([*(f"x{k} {kinds[c]}" for k, c in enumerate(names)), "ids array<long>", "cover double"])
    text_at = F.col(f"x{names.index(text_col)}").cast("string")
    for b in range(blocks):
        part = [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").toLocalIterator()]
        out = out.mapInArrow(_checker(part, least, threshold), f"{base}, items_new array<long>, cover_new double")
        out = out.select(text_at.alias("read"), *(f"x{k}" for k in range(len(names))), F.array_union("ids", "items_new").alias("ids"), F.greatest("cover", "cover_new").alias("cover"))
        if b % HELD_BLOCKS == HELD_BLOCKS - 1 and b + 1 < blocks:
            out = durable(out, "contaminated")
    return out.select(*(F.col(f"x{k}").alias(c) for k, c in enumerate(names)), F.array_sort("ids").alias("item_ids"), F.col("cover").alias("coverage"), (F.size("ids") > 0).alias("contaminated"))
