"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram binds the vectors of its symbols, each one rolled by its
place, by elementwise products; a text bundles its n-grams by their sum. A language's prototype bundles all its learned texts, and a text gets
the language whose prototype has the highest cosine with the text's own vector.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.durable import as_id, free_prefix, release_memory, small_batches
from quarry.llm.hashing import splitmix

#: Elements of a vector, symbols of an n-gram, the vectors' seed.
SIZE, GRAM, SEED = 1024, 3, 11
#: Languages that prototypes are collected for: 8 KB each. More than that are an error, as they travel to each task.
MOST_LANGUAGES = 10_000
#: Characters that are counted at a time; n-grams whose vectors exist at a time.
PART, VECTORS = 1 << 19, 4096
#: Rows whose vectors exist at a time.
ROWS = 512
#: What stands for everything between words, and for a text nobody can tell.
GAP, UNKNOWN = 0, "und"


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3. A null id is held out of learning too."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(True))


class _Kinds:
    """0 for gaps, 1 for marks (part of words), 2 for letters, by code point; found out when first met."""

    def __init__(self) -> None:
        self.of = np.full(0x110000, 255, np.uint8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        kinds = self.of[points]
        if (kinds == 255).any():
            for p in np.unique(points[kinds == 255]):
                c = chr(p)
                self.of[p] = 2 if c.isalpha() else 1 if unicodedata.category(c)[0] == "M" else 0
            kinds = self.of[points]
        return kinds


_kinds: list[_Kinds] = []


def symbols(text: str, kinds: _Kinds) -> tuple[np.ndarray, bool]:
    """(code points of the case-folded text with one GAP for everything between words, whether there is a letter)."""
    points = np.frombuffer(text.casefold().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = kinds(points)
    points[kind == 0] = GAP
    gap = points == GAP
    return points[~(gap & np.concatenate([[False], gap[:-1]]))], bool((kind == 2).any())


def letter_vectors(points: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A row of +1 and -1 (int8) for each code point, the same wherever it is drawn."""
    words = size // 64
    with np.errstate(over="ignore"):
        key = splitmix(points.astype(np.uint64) + np.uint64(seed) * np.uint64(1 << 32))
        bits = splitmix(key[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def _numbered(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, the place of each one among them); values are from 0 to below the bound."""
    if bound > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(bound, bool)
    seen[values] = True
    known = np.flatnonzero(seen)
    place = np.empty(bound, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    return known, place[values]


def bundles(streams: list[np.ndarray], owners: np.ndarray, n: int, size: int = SIZE, gram: int = GRAM, seed: int = SEED) -> np.ndarray:
    """n vectors: of each owner the bundle of its streams of symbols, as exact int64. Streams shorter than an n-gram bundle nothing."""
    out = np.zeros((n, size), np.int64)
    flat = np.concatenate(streams)
    last = len(flat) - gram + 1
    if last <= 0:
        return out
    stream = np.repeat(np.arange(len(streams), dtype=np.int32), [len(s) for s in streams])
    whole = stream[:last] == stream[gram - 1 :]
    letters, place = _numbered(flat, 0x110000)
    key = place[:last].astype(np.int64)
    for j in range(1, gram):
        key = key * len(letters) + place[j : j + last]  # a part has at most 2 ** 19 letters, and three such places fit into 57 bits
    grams, number = _numbered(key[whole], len(letters) ** gram)
    owner = owners.astype(np.int64)[stream[:last][whole]]
    vectors = letter_vectors(letters, size, seed)
    rolled = [np.roll(vectors, gram - 1 - j, axis=1) for j in range(gram)]
    step = max(1, min(VECTORS, (1 << 22) // n))
    if n * len(grams) <= 1 << 22:
        every = np.bincount(owner * len(grams) + number, minlength=n * len(grams)).reshape(n, -1)
        counted = lambda low, high: every[:, low:high]
    else:
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        ends = np.searchsorted(number, np.arange(len(grams) + 1))
        counted = lambda low, high: np.bincount(owner[ends[low] : ends[high]] * (high - low) + number[ends[low] : ends[high]] - low, minlength=n * (high - low)).reshape(n, -1)
    for low in range(0, len(grams), step):
        rest = grams[low : low + step]
        counts = counted(low, low + len(rest))
        bound = None
        for j in reversed(range(gram)):
            rest, at = np.divmod(rest, len(letters))
            bound = rolled[j][at] if bound is None else bound * rolled[j][at]
        out += (counts.astype(np.float32) @ bound.astype(np.float32)).astype(np.int64)  # whole numbers below 2 ** 24: exact
    return out


def add_bundles(total: np.ndarray, letter: np.ndarray, texts: Iterable[str | None], owners: Iterable[int], gram: int = GRAM, seed: int = SEED) -> None:
    """Adds each text's bundle to its owner's row of total, and marks the owners of letters. A long text is read in parts that share gram - 1
    symbols, so its bundle is that of the whole; every text begins and ends with a gap."""
    if not _kinds:
        _kinds.append(_Kinds())
    streams: list[np.ndarray] = []
    own: list[int] = []
    held = 0

    def flush() -> None:
        rows, at = np.unique(own, return_inverse=True)
        total[rows] += bundles(streams, at, len(rows), total.shape[1], gram, seed)
        streams.clear()
        own.clear()

    for owner, text in zip(owners, texts, strict=True):
        carried = np.zeros(1, np.int64)
        for low in range(0, len(text or ""), PART):
            points, has = symbols(text[low : low + PART], _kinds[0])
            if carried[-1:] == GAP and len(points) and points[0] == GAP:
                points = points[1:]
            points = np.concatenate([carried, points, [GAP] if low + PART >= len(text) and (not len(points) or points[-1] != GAP) else []]).astype(np.int64)
            carried = points[max(0, len(points) - max(gram - 1, 1)) :]
            letter[owner] |= has
            streams.append(points if gram > 1 or not low else points[1:])
            own.append(owner)
            held += len(points)
            if held >= PART:
                flush()
                held = 0
    if streams:
        flush()


def _learner(size: int, gram: int, seed: int):
    """(lang, vector) rows of a task: the bundle of all its texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        total = np.zeros((0, size), np.int64)

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([v.tolist() for v in total[: len(known)]], pa.list_(pa.int64()))], names=["lang", "vector"])

        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                owners = [known.setdefault(lang, len(known)) for lang in part.column(0).to_pylist()]
                if len(known) > len(total):
                    total = np.concatenate([total, np.zeros((len(known) - len(total), size), np.int64)])
                add_bundles(total, np.zeros(len(total), bool), part.column(1).to_pylist(), owners, gram, seed)
                if len(known) >= 1024:
                    yield handed()
                    known.clear()
                    total = total[:0]
        if known:
            yield handed()
        release_memory()

    return run


@dataclass(frozen=True)
class Profiles:
    """Learned languages in order, and a row of unit length for each one's prototype."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    size: int
    gram: int
    seed: int


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SIZE, gram: int = GRAM, seed: int = SEED) -> Profiles:
    """Prototypes from all rows of docs that are not held out and whose language is not null.

    size is a multiple of 64. Texts without letters and null texts add nothing; a language with no n-gram at all isn't learned. Each task sums
    its own rows first, so what is shuffled is a vector for each task and language. More than MOST_LANGUAGES languages are a ValueError.
    """
    if size % 64 or size <= 0 or not 1 <= gram <= 3:
        raise ValueError("size is a positive multiple of 64, gram is 1 to 3")
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out(F.col(f"`{id_col}`"))).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = rows.where("lang is not null and text is not null").mapInArrow(_learner(size, gram, seed), "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", F.col("v.x").alias("v"))
    known = vectors.limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = sorted((r["lang"], np.array(r["v"], np.float64)) for r in known if any(r["v"]))
    unit = [v / np.sqrt((v * v).sum()) for _, v in found]
    return Profiles(tuple(name for name, _ in found), np.array(unit).reshape(len(found), size), size, gram, seed)


def _judge(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*profiles.languages, UNKNOWN], object)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                n = part.num_rows
                total, letter = np.zeros((n, profiles.size), np.int64), np.zeros(n, bool)
                add_bundles(total, letter, part.column(1).to_pylist(), range(n), profiles.gram, profiles.seed)
                own = total.astype(np.float64)
                length = np.sqrt((own * own).sum(1))
                cosine = np.zeros((n, len(profiles.languages) + 1))
                cosine[:, :-1] = own @ profiles.prototypes.T / np.where(length > 0, length, 1)[:, None]
                cosine = np.round(np.clip(cosine, 0, 1), 9)
                told = letter & (len(profiles.languages) > 0)
                best = cosine.argmax(1)  # the first of equals: the least name
                score = np.where(told, cosine[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(told, names[best], UNKNOWN), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])
        release_memory()

    return run


def identify_languages(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred and score of each row of docs, by its whole text and nothing else. No shuffle.

    score is the cosine with the predicted language's prototype, cut to 0..1 and rounded to nine places; of equal ones the least name wins.
    A null text, one without a letter, and any text where nothing was learned get "und" and 0. Null and repeated ids are rows like others.
    """
    small_batches(docs.sparkSession)
    p = free_prefix(docs, ["id"])
    rows = docs.select(as_id(F.col(f"`{id_col}`")).alias(f"{p}id"), F.col(f"`{text_col}`").cast("string").alias(f"{p}text"))
    out = rows.mapInArrow(_judge(profiles), "id long, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
