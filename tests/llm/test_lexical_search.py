"""Ranked lexical search by WAND."""

import math
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lexical_search as ls
from quarry.llm.wand import Heap, Shard

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items, k=10):
    seen = [(i, Counter(ls.terms_of(t))) for i, t in docs]
    seen = [(i, c) for i, c in seen if c]
    n_docs, n_terms = len(seen), sum(sum(c.values()) for _, c in seen)
    df = Counter(t for _, c in seen for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(ls.terms_of(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for i, c in seen:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


def test_terms():
    assert ls.terms_of("Ab-c É x 9_z\u007f\tÀ") == ["ab", "c", "É x", "9", "z", "À"] and ls.terms_of(None) == []


def test_search_offers_what_brute_force_ranks():
    r = np.random.default_rng(5)
    for _ in range(30):
        n, terms = 200, 12
        has = r.random((n, terms)) < r.random(terms)
        impact = r.integers(1, 6, (n, terms)) * has  # few values: many ties
        row, term = np.nonzero(has)
        ids = r.permutation(n).tolist()
        shards = [Shard(ids[low : low + 70], row[own] - low, term[own], impact[row[own], term[own]], window=16) for low in range(0, n, 70) for own in [np.flatnonzero((row >= low) & (row < low + 70))]]
        for asked in ([0], [1, 5], list(range(terms)), [99]):
            heap = Heap(7)
            for s in shards:
                s.search(asked, heap)
            total = impact[:, [t for t in asked if t < terms]].sum(1)
            want = sorted(((int(s), ids[d]) for d, s in enumerate(total) if s), key=lambda x: (-x[0], x[1]))[:7]
            assert heap.best() == want


def test_skips_documents_that_cannot_enter():
    row = np.concatenate([np.arange(4000), [3999]])
    term = np.concatenate([np.zeros(4000, int), [1]])
    shard = Shard(list(range(4000)), row, term, np.where(term == 1, 100, 1), window=100)
    heap = Heap(1)
    shard.search([0, 1], heap)
    assert heap.best() == [(101, 3999)] and shard.looked <= 100


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, parts, monkeypatch):
    r = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)] + ["É", "THE", "the"]
    docs = [(int(k) if k % 9 else None, " ".join(r.choice(words, r.integers(0, 30)))) for k in range(300)] + [(5, "w1 w2"), (5, "w1 w2"), (400, None), (401, ""), (402, "w3 " * 60_000)]
    items = [(int(k), " ".join(r.choice(words, 6))) for k in range(12)] + [(3, "w1 w9"), (None, "the w4"), (50, None), (51, " .. "), (52, "nowhere")]
    d, i = spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS)
    assert got(ls.lexical_top(d, i)) == brute(docs, items)
    monkeypatch.setattr(ls, "BLOCK_BYTES", 20)  # a few items a pass
    assert got(ls.lexical_top(d, i, k=3)) == brute(docs, items, 3)


def test_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(ls, "splitmix", lambda x: x & np.uint64(3))
    from quarry.llm.hashing import joined

    words = [f"t{k}" for k in range(30)]
    ((_, _, data, offsets),) = joined(["t1 t29 zz t1", "t7 t07", None])
    counts, text, term = ls.Dictionary(words).find(data, offsets)
    assert counts.tolist() == [4, 2, 0] and sorted(zip(text.tolist(), term.tolist())) == [(0, 1), (0, 1), (0, 29), (1, 7)]


def test_empty_tables_and_clashes(spark):
    d, i = spark.createDataFrame([(1, "a b", 7, 8)], DOCS + ", score int, `a.b` int"), spark.createDataFrame([(2, "b", 1)], ITEMS + ", rank int")
    assert got(ls.lexical_top(d, i)) == brute([(1, "a b")], [(2, "b")])
    assert ls.lexical_top(d, i.limit(0)).count() == 0 and ls.lexical_top(d.limit(0), i).count() == 0
    assert ls.lexical_top(d.limit(0), i.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
