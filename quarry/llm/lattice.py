"""Sampled segmentations of texts into vocabulary pieces: Gumbel top-k without replacement over the lattice of all segmentations.

The lattice of a text has a node for each place between characters and an edge for each vocabulary piece that spells the characters
between two nodes (characters without a piece have an edge of UTF-8 byte tokens). Backward sums give each edge its probability given its
first node. The k segmentations with the largest Gumbel-perturbed log probabilities are found by an A-star search from the text's start:
a path is walked edge by edge, and at each node the untaken edges stay on the agenda as one entry whose perturbed value, the largest
among all their completions, is drawn as a Gumbel variable below the value of the path they left. The largest entry is expanded next. No
segmentation comes twice, and the (k+1)-th value is the threshold from which inclusion scores follow.

All draws are hashes of the row's key, the sample, the word and the step, so results don't depend on partitions or batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.durable import as_id, release_memory, small_batches
from quarry.llm.hashing import U64, splitmix

SPACE = "▁"
#: Characters of texts that are read together. More share more words but take more memory, about 200 bytes a character.
GROUP = 1 << 20
#: No Gumbel draw from 53 bits is larger (they end at 36.8), so an entry with a location this far below another value is never larger.
_REACH = 37.0


@dataclass
class Pieces:
    """Pieces with log weights. Ids 0-255 are byte tokens, piece k has id 256 + k."""

    texts: list[str]
    weights: list[float]
    byte_weight: float

    @classmethod
    def from_model(cls, path: str, power: float = 1.0) -> Pieces:
        """Of a SentencePiece model file. Its scores are negative merge ranks; a piece of rank r weighs -power * log(2 + r)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        kept = [k for k in ids if SPACE not in model.id_to_piece(k).lstrip(SPACE) and "\n" not in model.id_to_piece(k)]
        weights = [-power * float(np.log(2 + max(0.0, -model.get_score(k)))) for k in kept]
        return cls([model.id_to_piece(k).replace(SPACE, " ") for k in kept], weights, -power * float(np.log(2 + len(kept))))

    def decode(self, ids) -> str:
        """The text that the tokens spell."""
        return b"".join(bytes([i]) if i < 256 else self.texts[i - 256].encode() for i in ids).decode("utf-8", "surrogatepass")

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens one after the other, where each starts)."""
        parts = [bytes([b]) for b in range(256)] + [t.encode() for t in self.texts]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def spell(self, ids: np.ndarray) -> bytes:
        data, start = self.spelled
        n = start[ids + 1] - start[ids]
        at = np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return data[at].tobytes()

    @cached_property
    def index(self) -> Beginnings:
        return Beginnings(self.texts)


class Beginnings:
    """A hash table of all beginnings of pieces."""

    def __init__(self, texts: list[str]):
        self.longest = max(map(len, texts), default=1)
        whole = {t: k for k, t in enumerate(texts)}
        starts = sorted({t[:n] for t in texts for n in range(1, len(t) + 1)})
        stops = np.cumsum([len(t) for t in starts])
        self.hash = _spans(_prefix(_points("".join(starts))), np.concatenate([[0], stops[:-1]]), stops) if starts else np.zeros(0, U64)
        #: The piece that a beginning is, or -1.
        self.piece = np.array([whole.get(t, -1) for t in starts], np.int64)
        slot = (self.hash >> U64(42)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        same = slot[order[1:]] == slot[order[:-1]]
        self.next = np.full(len(starts), -1, np.int32)  # in the same slot
        self.next[order[:-1][same]] = order[1:][same]
        self.first = np.full(1 << 22, -1, np.int32)
        heads = order[np.concatenate([[True], ~same])] if len(order) else order
        self.first[slot[heads]] = heads

    def find(self, h: np.ndarray) -> np.ndarray:
        """The beginning that has each hash, or -1."""
        out = self.first[(h >> U64(42)).astype(np.int64)]
        wrong = np.flatnonzero(out >= 0)
        wrong = wrong[self.hash[out[wrong]] != h[wrong]]
        while len(wrong):
            out[wrong] = self.next[out[wrong]]
            wrong = wrong[out[wrong] >= 0]
            wrong = wrong[self.hash[out[wrong]] != h[wrong]]
        return out


_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(which: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        _powers[which] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, GROUP), (_BASE, _INVERSE)[which], U64)]), dtype=U64)
    return _powers[which][:n]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points) + 1, U64)
    np.cumsum(splitmix(points.astype(U64)) * _power(0, len(points)), out=out[1:])
    return out


def _spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return splitmix((prefix[end] - prefix[start]) * _power(1, len(prefix))[start])


class Lattice:
    """The lattices of distinct words. Nodes are numbered through all words; edges are sorted by node."""

    def __init__(self, points: np.ndarray, size: np.ndarray, pieces: Pieces):
        """points: the words' characters, one word after the other."""
        index, words = pieces.index, size
        self.end = np.cumsum(size) + np.arange(len(words))  # each word has one node more than characters
        self.first = self.end - size
        place = np.arange(len(points))  # characters
        word = np.repeat(np.arange(len(words)), size)
        stop = np.cumsum(size)[word]
        prefix = _prefix(points)
        rows, pieces_found, lengths = [], [], []
        single = np.zeros(len(points), bool)
        alive = place  # where what was read so far begins a piece
        for n in range(1, index.longest + 1):
            at = alive[alive + n <= stop[alive]]
            if not len(at):
                break
            start = index.find(_spans(prefix, at, at + n))
            begins = np.flatnonzero(start >= 0)
            alive = at = at[begins]
            found = index.piece[start[begins]]
            good = np.flatnonzero(found >= 0)
            at, found = at[good], found[good]
            if n == 1:
                single[at] = True
            rows.append(at)
            pieces_found.append(found + 256)
            lengths.append(n)
        bare = np.flatnonzero(~single)
        p = points[bare]
        n_bytes = 1 + (p >= 0x80).astype(np.int64) + (p >= 0x800) + (p >= 0x10000)
        rows.append(bare)
        pieces_found.append(-1 - p.astype(np.int64))
        lengths.append(1)
        weights = np.asarray([0.0] * 256 + pieces.weights)
        nodes = int(self.end[-1]) + 1 if len(words) else 0
        degree = np.zeros(nodes + 1, np.int64)
        for at in rows:
            degree[at + word[at] + 1] += 1
        self.start = np.cumsum(degree)
        filled, m = self.start[:-1].copy(), int(self.start[-1])
        node, self.piece, self.to, weight = np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m)
        for k in range(len(rows) - 1, -1, -1):  # of a node's edges the longest come first
            own = rows[k] + word[rows[k]]
            spot = filled[own]
            filled[own] += 1
            node[spot], self.piece[spot], self.to[spot] = own, pieces_found[k], own + lengths[k]
            weight[spot] = weights[pieces_found[k]] if k < len(rows) - 1 else pieces.byte_weight * n_bytes
        left = np.repeat(self.end, size + 1) - np.arange(nodes) if nodes else np.zeros(0, np.int64)
        back = np.zeros(nodes)
        far = left[node]
        most = int(far.max()) if m else 0
        by = np.argsort(far.astype(np.uint16) if most < 1 << 16 else far, kind="stable")  # nodes nearest to their word's end first
        cuts = np.cumsum(np.bincount(far, minlength=most + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e = by[a:b]
            heads = np.flatnonzero(np.concatenate([[True], node[e[1:]] != node[e[:-1]]])) if len(e) else e
            if len(e):
                back[node[e[heads]]] = np.logaddexp.reduceat(weight[e] + back[self.to[e]], heads)
        del by, far, rows, pieces_found
        weight += back[self.to]
        weight -= back[node]
        self.log_q = weight
        self.q = np.minimum(np.exp(self.log_q), 1.0)
        total = np.concatenate([[0.0], np.cumsum(self.q)])
        self.below = total[1:] - total[self.start[node]]  # the share of the edge and those before it
        self.below[self.start[1:] - 1] = 2.0  # the last edge takes what rounding leaves; the end of a word has none
        self.final = self.to == np.repeat(self.end, size + 1)[node] if nodes else np.zeros(0, bool)

    def joined(self, other: Lattice) -> Lattice:
        """The words of both; those of the other one come last."""
        out, nodes = object.__new__(Lattice), len(self.start) - 1
        for f in ("piece", "log_q", "q", "below", "final"):
            setattr(out, f, np.concatenate([getattr(self, f), getattr(other, f)]))
        out.to = np.concatenate([self.to, other.to + np.int32(nodes)])
        out.start = np.concatenate([self.start[:-1], other.start + self.start[-1]])
        out.first, out.end = np.concatenate([self.first, other.first + nodes]), np.concatenate([self.end, other.end + nodes])
        return out

    def chosen(self, words: np.ndarray) -> Lattice:
        """Some of the words, in this order."""
        out = object.__new__(Lattice)
        size = self.end[words] - self.first[words] + 1
        node = _ranges(self.first[words], size)
        out.end = np.cumsum(size) - 1
        out.first = out.end - size + 1
        edge = _ranges(self.start[self.first[words]], self.start[self.end[words]] - self.start[self.first[words]])
        for f in ("piece", "log_q", "q", "below", "final"):
            setattr(out, f, getattr(self, f)[edge])
        out.start = np.concatenate([[0], np.cumsum(self.start[node + 1] - self.start[node])])
        moved = np.repeat(out.first - self.first[words], self.start[self.end[words]] - self.start[self.first[words]])
        out.to = (self.to[edge] + moved).astype(np.int32)
        return out

    def step(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by its probability."""
        e = self.start[node]
        more = np.flatnonzero(u >= self.below[e])
        while len(more):
            e[more] += 1
            more = more[u[more] >= self.below[e[more]]]
        return e

    def walk(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, count) of one segmentation of each word, one after the other."""
        node, live, taken, count, step = self.first[word].copy(), np.arange(len(word)), [], np.zeros(len(word), np.int64), 0
        while len(live):
            live = live[node[live] < self.end[word[live]]]
            e = self.step(node[live], uniform(seed[live], step))
            taken.append((live.astype(np.int32), e.astype(np.int32)))
            count[live] += 1
            node[live] = self.to[e]
            step += 1
        edges, first = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        for k, (own, e) in enumerate(taken):
            edges[first[own] + k] = e
        return edges, count


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i] to start[i] + size[i], one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _times(n: int, factor: int) -> np.uint64:
    return U64(n * factor % (1 << 64))


def uniform(seed: np.ndarray, step: int) -> np.ndarray:
    return (splitmix(seed + _times(step + 1, 0xA0761D6478BD642F)) >> U64(11)).astype(np.float64) * 2.0**-53


def _below(location: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with these locations, given that they are below the bound."""
    return location - np.log(np.exp(np.minimum(location - bound, 700.0)) - np.log(np.maximum(u, 2.0**-53)))


def gumbel_top_k(lattice: Lattice, words: np.ndarray, seed: int, walks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[tuple[float, np.ndarray, float]]:
    """(perturbed value, edges, log probability) of up to k distinct segmentations of a text, then one entry with the next value.

    words: the text's words as numbers of the lattice. walks: for each sample the edges of an independent walk over all words, the
    edge count before each word and the sum of log probabilities before each word (both with the total at the end).
    """
    key = np.array([seed], U64)
    bound = -float(np.log(-np.log(max(uniform(key, 0)[0], 2.0**-53))))
    edges = walks[0][0]
    found = [(bound, edges, float(walks[0][2][-1]))]
    agenda: list[tuple[float, int, int, frozenset]] = []  # value, sample, step, edges that are taken there
    salts = splitmix(key + np.arange(1, k + 2, dtype=U64) * U64(0xD1342543DE82EF95))

    def offer(sample: int, first: int, value: float, base: float, taken: frozenset) -> None:
        # locations fall along the path; k + 1 entries at most can be expanded, and what can't be among the largest is not looked at
        path, values, before, done, size = found[sample][1], np.zeros(0), base, first, 384
        while done < len(path) and (len(values) <= k or before + _REACH >= values[0]):
            e = path[done : done + size]
            log_q, mass = lattice.log_q[e], 1.0 - lattice.q[e]
            after = before + np.cumsum(log_q)
            if done == first and taken:
                mass[0] -= sum(lattice.q[t] for t in taken)
            ways = np.flatnonzero(mass > 1e-15)
            if len(ways):
                at = done + ways
                draw = (splitmix(at.astype(U64) * U64(0x9FB21C651E98DF25) + salts[sample]) >> U64(11)).astype(np.float64) * 2.0**-53
                v = _below((after - log_q)[ways] + np.log(mass[ways]), value, draw)
                best = np.argpartition(-v, k)[: k + 1] if len(v) > k + 1 else np.arange(len(v))  # no more can be expanded
                for x, t in zip(v[best].tolist(), at[best].tolist(), strict=True):
                    own = frozenset([int(path[t])])
                    agenda.append((x, sample, t, own | taken if t == first else own))
                values = np.sort(np.concatenate([values, v[best]]))[-k - 1 :]
            before, done, size = float(after[-1]), done + size, 512

    offer(0, 0, bound, 0.0, frozenset())
    while agenda:
        best = max(range(len(agenda)), key=lambda i: agenda[i][0])
        value, parent, at, taken = agenda.pop(best)
        if len(found) == k:
            found.append((value, np.zeros(0, np.int64), 0.0))
            break
        sample = len(found)
        path = found[parent][1]
        before = float(lattice.log_q[path[:at]].sum())
        node = _node_of(lattice, int(path[at]))
        u = uniform(splitmix(key + U64(at + 1)), 1000 + sample)
        options = np.array([e for e in range(int(lattice.start[node]), int(lattice.start[node + 1])) if e not in taken])
        share = np.cumsum(lattice.q[options])
        chosen = int(options[min(int(np.searchsorted(share, u[0] * share[-1], side="right")), len(options) - 1)])
        # the rest of the word is walked here, later words as in this sample's own walk
        word = int(np.searchsorted(lattice.end, node))
        own, node, step = [chosen], int(lattice.to[chosen]), 0
        while node < lattice.end[word]:
            e = int(lattice.step(np.array([node]), uniform(splitmix(key + U64(at + 1)), 2000 + 1000 * sample + step))[0])
            own.append(e)
            node = int(lattice.to[e])
            step += 1
        place = int(lattice.final[path[:at]].sum())  # words that the path has finished
        walk, counts, sums = walks[sample]
        edges = np.concatenate([path[:at], own, walk[counts[place + 1] :]]).astype(np.int64)
        total = before + float(lattice.log_q[own].sum()) + float(sums[-1] - sums[place + 1])
        found.append((value, edges, total))
        offer(sample, at, value, before, taken)
    return found


def _node_of(lattice: Lattice, edge: int) -> int:
    return int(np.searchsorted(lattice.start, edge, side="right")) - 1


def _tokens(edges: np.ndarray, lattice: Lattice) -> np.ndarray:
    ids = lattice.piece[edges]
    low = ids.min() if len(ids) else 0
    if low >= 0:
        return ids
    ids = np.where((ids < 0) & (ids >= -128), -1 - ids, ids)  # ASCII characters are one byte token
    if low >= -128:
        return ids
    out = []
    for i in ids.tolist():
        out += [i] if i >= 0 else list(chr(-1 - i).encode("utf-8", "surrogatepass"))
    return np.array(out, np.int64)


def sample_texts(texts: list[str], keys: list[int], pieces: Pieces, k: int, group: int = GROUP, known: Known | None = None) -> Iterator[list[tuple[np.ndarray, float, float]]]:
    """For each text (token ids, log probability, log inclusion score) of up to k segmentations, in order of their perturbed values.

    known: lattices of frequent words from earlier calls with the same pieces, to which those of these texts are added.
    """
    low, known = 0, known or Known(pieces, group // 2)
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= group):
            size += len(texts[high])
            high += 1
        yield from _sample(texts[low:high], keys[low:high], known, k)
        low = high


def split_words(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words start, in texts that end at the given places. A word is a run of other characters with the spaces before it, a run of
    spaces at the end of a line, or a run of line feeds. Pieces never reach over these bounds, so a text's lattice is a chain of its words' lattices."""
    kind = (points == 32).astype(np.int8) + 2 * (points == 10).astype(np.int8)
    begin = np.ones(len(points) + 1, bool)
    begin[1:-1] = (kind[1:] != kind[:-1]) & ((kind[:-1] != 1) | (kind[1:] != 0))
    begin[ends] = True
    return np.flatnonzero(begin[:-1])


class Known:
    """Lattices of words that were frequent so far. Nodes beyond `limit` aren't kept; which words are changes time, not results."""

    def __init__(self, pieces: Pieces, limit: int):
        self.pieces, self.limit = pieces, limit
        self.lattice = Lattice(np.zeros(0, np.uint32), np.zeros(0, np.int64), pieces)
        self.hash, self.number = np.zeros(0, U64), np.zeros(0, np.int64)  # sorted by hash

    def read(self, points: np.ndarray, start: np.ndarray) -> tuple[Lattice, np.ndarray]:
        """(a lattice of all words, the words by their numbers in it)."""
        size, old = np.diff(np.append(start, len(points))), len(self.hash)
        hashes, first, word, count = np.unique(_spans(_prefix(points), start, start + size), return_index=True, return_inverse=True, return_counts=True)
        place = np.searchsorted(self.hash, hashes)
        hit = np.zeros(len(hashes), bool)
        if old:
            hit = self.hash[np.minimum(place, old - 1)] == hashes
        number = np.empty(len(hashes), np.int64)
        number[hit] = self.number[place[hit]]
        new = np.flatnonzero(~hit)
        if not len(new):
            return self.lattice, number[word]
        number[new] = np.arange(old, old + len(new))
        own = first[new]
        every = self.lattice.joined(Lattice(points[_ranges(start[own], size[own])], size[own], self.pieces))
        again = new[count[new] > 1]
        again = again[np.cumsum(size[first[again]] + 1) <= self.limit - (len(self.lattice.start) - 1)]
        if len(again):
            self.lattice = self.lattice.joined(every.chosen(number[again]))
            both = np.concatenate([self.hash, hashes[again]])
            order = np.argsort(both)
            self.hash, self.number = both[order], np.concatenate([self.number, np.arange(old, old + len(again))])[order]
        return every, number[word]


def _sample(texts: list[str], keys: list[int], known: Known, k: int) -> Iterator[list[tuple[np.ndarray, float, float]]]:
    points, stops = _points("".join(texts)), np.cumsum([len(t) for t in texts])
    start = split_words(points, stops)
    lattice, word = known.read(points, start)
    del points
    counts = np.diff(np.searchsorted(start, stops), prepend=0)
    ends = np.cumsum(counts)
    seed = splitmix(np.array([k_ % (1 << 64) for k_ in keys], U64))
    place = np.arange(len(word)) - np.repeat(ends - counts, counts)
    each = np.repeat(seed, counts) + (place.astype(U64) + U64(1)) * U64(0xE7037ED1A0B428DB)
    walks = []
    for s in range(k):
        edges, n = lattice.walk(word, splitmix(each + _times(s, 0x8EBC6AF09C88C6E3))) if len(word) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        before = np.concatenate([[0], np.cumsum(n)])
        sums = np.concatenate([[0.0], np.cumsum(lattice.log_q[edges])]) if len(word) else np.zeros(1)
        walks.append((edges, before, sums))
    for t in range(len(texts)):
        a, b = int(ends[t] - counts[t]), int(ends[t])
        if a == b:
            yield [(np.zeros(0, np.int64), 0.0, 0.0)]
            continue
        own = []
        for edges, before, sums in walks:
            x, y = int(before[a]), int(before[b])
            own.append((edges[x:y], before[a : b + 1] - x, sums[before[a : b + 1]] - sums[x]))
        found = gumbel_top_k(lattice, word[a:b], int(seed[t]), own, k)
        limit = found[k][0] if len(found) > k else -np.inf
        out = []
        for _, edges, log_p in found[:k]:
            gap = log_p - limit
            score = 0.0 if gap > 6 else gap if gap < -36 else float(np.log(-np.expm1(-np.exp(gap))))
            out.append((_tokens(edges, lattice), log_p, score))
        yield out


def _pieces_of(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a piece's texts, but for one long text, are read as one group and its token ids stay small."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        low, total = 0, 0
        for k, n in enumerate(size.tolist()):
            if k > low and total + n > group:
                yield batch.slice(low, k - low)
                low, total = k, 0
            total += n
        if batch.num_rows > low:
            yield batch.slice(low)


def _encoder(pieces: Pieces, k: int, ids: bool, group: int = GROUP):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(pieces, group // 2)
        for batch in _pieces_of(batches, group):
            n, probability, score, trip, digest, tokens = [], [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = [i if i is not None else int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            for text, found in zip(texts, sample_texts(texts, keys, pieces, k, group, known), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                n.append([len(i) for i, _, _ in found])
                probability.append([p for _, p, _ in found])
                score.append([s for _, _, s in found])
                trip.append(all(pieces.spell(i) == raw for i, _, _ in found))
                digest.append([hashlib.blake2b(i.astype(np.int32).tobytes(), digest_size=16).hexdigest() for i, _, _ in found])
                if ids:
                    tokens.append([i.astype(np.int32) for i, _, _ in found])
            columns = {"n_tokens": pa.array(n, pa.list_(pa.int64())), "log_prob": pa.array(probability, pa.list_(pa.float64())), "inclusion": pa.array(score, pa.list_(pa.float64())), "tokens_hash": pa.array(digest, pa.list_(pa.string())), "round_trip": pa.array(trip)}
            del texts, keys
            if ids:
                columns["token_ids"] = pa.array(tokens, pa.list_(pa.list_(pa.int32())))
            columns |= {c: batch.column(c) for c in batch.schema.names[2:]} | {"id": batch.column(0)}
            yield pa.RecordBatch.from_pydict(columns)
            del columns, n, probability, score, digest, tokens
            release_memory()
        del known
        _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
        release_memory()

    return run


def encode_samples(docs: DataFrame, pieces: Pieces, k: int = 2, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, group: int = GROUP) -> DataFrame:
    """id_col and, as arrays with an entry for each sampled segmentation: n_tokens, log_prob, inclusion (log probability of being among
    the k), tokens_hash and, with ids=True, token_ids. round_trip says whether decoding every one of them gives the text again.

    A null or empty text has one segmentation of no tokens. Texts with fewer than k segmentations return all, with inclusion 0. Draws are
    seeded by the id, by the text's hash where it is null; rows that repeat an id and a text get equal results. Other columns are ignored. group: characters that a
    task reads together; it changes memory, not results.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(as_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "n_tokens array<long>, log_prob array<double>, inclusion array<double>, tokens_hash array<string>, round_trip boolean" + (", token_ids array<array<int>>" if ids else "")
    out = rows.mapInArrow(_encoder(pieces, k, ids, group), f"{kind}, id long")
    return out.select(F.col("id").alias(id_col), *(c for c in out.columns if c != "id"))


def _decoder(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = [None if row is None else [None if i is None else pieces.spell(np.asarray(i, np.int64)).decode("utf-8", "surrogatepass") for i in row] for row in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.list_(pa.string())), *batch.columns[1:]], names=["texts", *batch.schema.names[1:]])

    return run


def decode_samples(samples: DataFrame, pieces: Pieces, ids_col: str = "token_ids", out_col: str = "texts") -> DataFrame:
    """samples with out_col added (replaced if there): for each segmentation of ids_col, arrays of token ids, the text that its tokens spell.

    Null stays null, no tokens spell an empty text. A token id outside the vocabulary, or bytes that are no UTF-8, are an error.
    """
    names = [c for c in samples.columns if c != out_col]
    kinds = dict(samples.dtypes)
    rows = samples.select(F.col(f"`{ids_col}`").cast("array<array<int>>").alias("ids"), *(F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(names)))
    out = rows.mapInArrow(_decoder(pieces), ", ".join(["texts array<string>", *(f"x{k} {kinds[c]}" for k, c in enumerate(names))]))
    return out.select(*(F.col(f"x{k}").alias(c) for k, c in enumerate(names)), F.col("texts").alias(out_col))
