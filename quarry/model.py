"""Tables and options of the retrieval engine. Options validate themselves; out-of-range values raise ValueError."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

# Limits and defaults that users see.
OVERFETCH, MOST_FETCHED, MOST_NEIGHBOURS, MOST_HITS = 10, 10_000, 4096, 1000
MOST_LIST, MOST_ITEM_BYTES, MOST_QUERY_BYTES = 64, 1024, 1024
QUALITY = 0.3


@dataclass(frozen=True)
class TextIndex:
    """rows: the postings of trigrams by bucket; how many buckets there are, and the live chunks and their length in trigrams.
    dead: serials of ended revisions, whose chunks still stand in rows; a chunk's id divided by stride gives its serial."""

    rows: DataFrame
    buckets: int
    chunks: int
    length: int
    dead: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    stride: int = 1


@dataclass(frozen=True)
class VectorCells:
    """rows: chunk_id, embedding, gap (distance from the center) and cell; cells: (cell, center, radius, size) of all of them."""

    rows: DataFrame
    cells: tuple[tuple[int, tuple[float, ...], float, int], ...]


@dataclass(frozen=True)
class Corpus:
    """documents: id, path, title, topic, category, depth, tags, date, content_hash, last_indexed, size_bytes.
    chunks: id, document_id, chunk_index, heading, level, content, token_count, quality_score, context_text. vectors: chunk_id, embedding.
    text: the stored text index of just these chunks; without one text search reads the chunks. cells: the same vectors by cell, likewise."""

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    text: TextIndex | None = None
    cells: VectorCells | None = None


class Later:
    """An index that is made when something of it is first asked for."""

    def __init__(self, make: Callable[[], TextIndex | VectorCells]):
        self.__dict__["_make"] = make

    def __getattr__(self, name: str):
        if name.startswith("__") or "_make" not in self.__dict__:
            raise AttributeError(name)
        made = self.__dict__.pop("_make")()
        self.__dict__.update(vars(made))
        return getattr(made, name)


class LazyCorpus(Corpus):
    """A corpus each part of which is made when it is first asked for."""

    def __init__(self, **makers: Callable):
        object.__setattr__(self, "makers", makers)

    documents = cached_property(lambda self: self.makers["documents"]())
    chunks = cached_property(lambda self: self.makers["chunks"]())
    vectors = cached_property(lambda self: self.makers["vectors"]())
    text = cached_property(lambda self: Later(self.makers["text"]))
    cells = cached_property(lambda self: Later(self.makers["cells"]))


def _listed(name: str, values: tuple[str, ...]) -> None:
    if len(values) > MOST_LIST or any(len(v.encode()) > MOST_ITEM_BYTES for v in values):
        raise ValueError(f"{name}: at most {MOST_LIST} items of {MOST_ITEM_BYTES} bytes")


@dataclass(frozen=True)
class Filters:
    category: str | None = None
    topic: str | None = None
    min_quality: float | None = None
    include_low_quality: bool = False
    path_globs: tuple[str, ...] = ()
    tags_any: tuple[str, ...] = ()
    tags_all: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None

    def __post_init__(self) -> None:
        for name in ("path_globs", "tags_any", "tags_all"):
            _listed(name, getattr(self, name))

    @property
    def threshold(self) -> float:
        """The least quality: 0 with low quality included, a finite min_quality clamped to 0..1, else the default."""
        if self.include_low_quality:
            return 0.0
        if self.min_quality is not None and math.isfinite(self.min_quality):
            return min(1.0, max(0.0, self.min_quality))
        return QUALITY

    @property
    def any(self) -> bool:
        return self.threshold > 0 or any((self.category, self.topic, self.path_globs, self.tags_any, self.tags_all, self.date_from, self.date_to))

    def fetch(self, limit: int) -> int:
        return min(OVERFETCH * limit, MOST_FETCHED) if self.any else limit


@dataclass(frozen=True)
class Fusion:
    k: float = 60.0
    heading: float = 2.0
    context: float = 1.0
    content: float = 1.0

    def __post_init__(self) -> None:
        weights = (self.heading, self.context, self.content)
        if not 1 <= self.k <= 1e6 or any(not 0 <= w <= 1e6 for w in weights) or not any(weights):
            raise ValueError("fusion: k in 1..1e6, weights in 0..1e6 and not all 0")

    @property
    def weights(self) -> tuple[float, float, float]:
        return self.heading, self.context, self.content


@dataclass(frozen=True)
class Mmr:
    enabled: bool = False
    lam: float = 0.7
    same_document_penalty: float = 0.0

    def __post_init__(self) -> None:
        if not 0 <= self.lam <= 1 or not 0 <= self.same_document_penalty <= 1:
            raise ValueError("mmr: lam and same_document_penalty in 0..1")


@dataclass(frozen=True)
class Parent:
    enabled: bool = False
    whole_document_below: int = 100
    max_tokens: int = 2000

    def __post_init__(self) -> None:
        if not self.whole_document_below < self.max_tokens <= 8192:
            raise ValueError("parent: whole_document_below < max_tokens <= 8192")


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 5
    filters: Filters = field(default_factory=Filters)
    fusion: Fusion = field(default_factory=Fusion)
    mmr: Mmr = field(default_factory=Mmr)
    parent: Parent = field(default_factory=Parent)
    rerank: bool = False
    min_confidence_ratio: float = 1.5

    @property
    def hits(self) -> int:
        return min(MOST_HITS, max(1, self.limit))

    @property
    def fused(self) -> int:
        """How many fused rows go on: the limit, or a wider pool where reranking follows."""
        return max(5 * self.hits, 50) if self.rerank else self.hits

    @property
    def pool(self) -> int:
        """Candidates of each leg."""
        return max(max(5 * self.hits, 50), 50) if self.mmr.enabled else max(5 * self.fused, 50)


@dataclass(frozen=True)
class GraphOptions:
    depth: int = 2
    fan_out: int = 5
    min_similarity: float = 0.3
    strategy: str = "all_chunks"
    filters: Filters = field(default_factory=lambda: Filters(include_low_quality=True))
    exclude_paths: tuple[str, ...] = ()
    dedup_by_path: bool = False
    max_nodes: int = 100
    max_seeds: int = 32

    def __post_init__(self) -> None:
        _listed("exclude_paths", self.exclude_paths)
        if self.strategy not in ("all_chunks", "centroid") or not 0 <= self.min_similarity <= 1:
            raise ValueError("graph: strategy all_chunks or centroid, min_similarity in 0..1")
        for name, low, high in (("depth", 0, 3), ("fan_out", 1, 20), ("max_nodes", 0, 2000), ("max_seeds", 1, 1000)):
            object.__setattr__(self, name, min(high, max(low, getattr(self, name))))


def checked_query(text: str) -> str:
    if len(text.encode()) > MOST_QUERY_BYTES:
        raise ValueError(f"a query has at most {MOST_QUERY_BYTES} bytes")
    return text
