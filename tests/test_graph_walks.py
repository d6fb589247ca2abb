"""Walks of many starts at once against a plain queue for each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.model import GraphOptions
from quarry.operators import graph
from tests.test_retrieval import corpus_of


def walk(vectors, path_of, start, o):
    """(nodes (id, parent, depth, chunk, path), questions, seeds used, seeds cut, budget cut) of one start, one queue entry after another."""
    every = sorted(c for c in vectors if path_of[c] == start)
    own, more, cut = every[: o.max_seeds], len(every) > o.max_seeds, False
    if not own:
        return None
    nodes, queue, barred, used = [], [], {start, *o.exclude_paths}, 0
    seen = set()
    if o.strategy == "centroid":
        seen |= set(own)
        mean = np.mean([vectors[c] for c in own], axis=0)
        if o.max_nodes == 0:
            cut = True
        else:
            nodes.append((0, None, 0, own[0], start))
            queue.append((0, mean / np.linalg.norm(mean), 0))
            used = len(own)
    else:
        for c in own:
            if len(nodes) >= o.max_nodes:
                cut = True
                break
            nodes.append((len(nodes), None, 0, c, start))
            queue.append((len(nodes) - 1, vectors[c], 0))
            seen.add(c)
            used += 1
    asked = 0
    while queue:
        parent, v, depth = queue.pop(0)
        if depth >= o.depth:
            continue
        if len(nodes) >= o.max_nodes:
            cut = True
            continue
        asked += 1
        added = 0
        distance = {x: float(np.sqrt(((vectors[x] - v) ** 2).sum())) for x in vectors}
        for x in sorted(vectors, key=lambda x: (distance[x], x))[: 2 * o.fan_out]:
            if added >= o.fan_out:
                break
            if x in seen or path_of[x] in barred or min(1, max(0, 1 - distance[x] ** 2 / 2)) < o.min_similarity:
                continue
            if len(nodes) >= o.max_nodes:
                cut = True
                break
            seen.add(x)
            if o.dedup_by_path:
                barred.add(path_of[x])
            nodes.append((len(nodes), parent, depth + 1, x, path_of[x]))
            queue.append((len(nodes) - 1, vectors[x], depth + 1))
            added += 1
    return nodes, asked, used, more, cut


@pytest.fixture(scope="module")
def kb(spark):
    kb = corpus_of(spark, [["t%d" % k for k in range(1 + d % 4)] for d in range(14)], dim=3)
    return kb, {r["chunk_id"]: np.array(r["embedding"], float) for r in kb.vectors.collect()}


@pytest.mark.parametrize(
    "o",
    [
        GraphOptions(min_similarity=0.1, fan_out=3, max_nodes=12),
        GraphOptions(min_similarity=0.0, fan_out=2, depth=3, max_seeds=2),
        GraphOptions(min_similarity=0.1, strategy="centroid", dedup_by_path=True, max_nodes=7, exclude_paths=("cat/top/3.md",)),
        GraphOptions(max_nodes=0),
        GraphOptions(depth=0, max_nodes=2),
        GraphOptions(max_nodes=0, strategy="centroid"),
    ],
)
def test_equals_a_queue_for_each_start(spark, kb, o):
    kb, vectors = kb
    path_of = {c: f"cat/top/{c // 100}.md" for c in vectors}
    starts = kb.documents.select((F.col("id") + 500).alias("start_id"), "path").union(spark.createDataFrame([(9, "no.md")], "start_id long, path string"))
    nodes, stats = graph.connection_graphs(kb, starts, o)
    got, told = {}, {r["start_id"]: r for r in stats.collect()}
    for r in nodes.collect():
        got.setdefault(r["start_id"], []).append((r["id"], r["parent_id"], r["depth"], r["chunk_id"], r["path"]))
    assert set(told) == {500 + d for d in range(14)}
    for d in range(14):
        want, asked, used, more, cut = walk(vectors, path_of, f"cat/top/{d}.md", o)
        assert sorted(got.get(500 + d, [])) == want
        s = told[500 + d]
        assert (s["total_nodes"], s["knn_queries"], s["seeds_used"], s["max_seed_chunks"], s["max_nodes"]) == (len(want), asked, used, more, cut)
