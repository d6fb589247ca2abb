"""Connection graphs: breadth-first walks over nearest neighbours from many documents at once, level by level, and their renderings.

The frontier of all walks is a table. Each level asks once for the neighbours of its distinct chunks, whichever walks they belong to; what a
walk admits depends on order, so its nodes and candidates, bounded by max_nodes and fan_out, meet in one group and are taken in turn there.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import fit_width
from quarry.model import MOST_NEIGHBOURS, Corpus, GraphOptions
from quarry.operators.predicates import predicate
from quarry.operators.retrieval import attach, knn
from quarry.storage import durable, plain_unions


@dataclass
class Node:
    id: int
    parent_id: int | None
    depth: int
    score: float
    chunk_id: int | None
    path: str
    heading: str | None
    snippet: str


@dataclass
class Graph:
    nodes: list[Node] = field(default_factory=list)
    knn_queries: int = 0
    seeds_used: int = 0
    truncation: list[str] = field(default_factory=list)


_NODE = "start_id long, id int, parent_id int, depth int, score double, chunk_id long, path string"
_STEP = f"{_NODE}, queries int, cut boolean"


def seeds(corpus: Corpus, starts: DataFrame, cap: int) -> DataFrame:
    """(start_id, path, chunk_id, at, embedding): of each start (start_id, path) up to cap + 1 chunks that have a vector, in order, at from 0."""
    doc = corpus.documents.select(F.col("id").alias("document_id"), "path").join(starts, "path")
    rows = corpus.chunks.join(doc, "document_id").select("start_id", "path", "chunk_index", F.col("id").alias("chunk_id")).join(corpus.vectors, "chunk_id")
    order = Window.partitionBy("start_id").orderBy("chunk_index", "chunk_id")
    return rows.withColumn("at", F.row_number().over(order) - 1).where(F.col("at") <= cap).select("start_id", "path", "chunk_id", "at", "embedding")


def centroids(seeds: DataFrame) -> DataFrame:
    """(start_id, vector): the mean of each start's vectors, of unit length unless it is zero."""
    means = seeds.select("start_id", F.posexplode("embedding").alias("k", "x")).groupBy("start_id", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = means.groupBy("start_id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return v.select("start_id", F.transform("v", lambda e: F.when(F.col("norm") > 0, e["x"] / F.col("norm")).otherwise(e["x"])).alias("vector"))


def _neighbours(corpus: Corpus, queries: DataFrame, options: GraphOptions) -> DataFrame:
    """(query_id, rank, chunk_id, distance, path): what passes the filters, at most twice the fan-out for each query, nearest first."""
    want = 2 * options.fan_out
    fetch = min(options.filters.fetch(want), MOST_NEIGHBOURS)
    rows = attach(knn(corpus.vectors, queries, fetch, corpus.cells), corpus).where(predicate(options.filters))
    order = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= want).select("query_id", "rank", "chunk_id", "distance", "path")


def _admitting(o: GraphOptions, depth: int):
    """Of one walk: its nodes so far (kind 0), chunks that it may not enter besides (1) and the candidates of its last level (2), to the nodes of
    the next level and a row without id that counts the questions asked and says whether the node budget cost something."""

    def admit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows[rows["kind"] == 0].sort_values("id")
        seen = set(rows.loc[rows["kind"] < 2, "chunk_id"].dropna().astype("int64"))
        barred = {*nodes.loc[nodes["depth"] == 0, "path"], *o.exclude_paths}
        if o.dedup_by_path:
            barred |= set(nodes["path"])
        found: dict[int, list] = defaultdict(list)
        for r in rows[rows["kind"] == 2].sort_values(["id", "rank"]).itertuples():
            found[int(r.id)].append(r)
        out, total, asked, cut = [], len(nodes), 0, False
        for parent in nodes.loc[nodes["depth"] == depth - 1, "id"].astype(int):
            if total >= o.max_nodes:
                cut = True
                break
            asked += 1
            added = 0
            for r in found[parent]:
                similarity = min(1.0, max(0.0, 1 - r.distance**2 / 2))
                if added == o.fan_out:
                    break
                if r.chunk_id in seen or r.path in barred or similarity < o.min_similarity:
                    continue
                if total >= o.max_nodes:
                    cut = True
                    break
                seen.add(int(r.chunk_id))
                if o.dedup_by_path:
                    barred.add(r.path)
                out.append((key[0], total, parent, depth, similarity, int(r.chunk_id), r.path, None, None))
                total, added = total + 1, added + 1
        out.append((key[0], None, None, depth, None, None, None, asked, cut))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _STEP.split(", ")])
        return frame.astype({"id": "Int32", "parent_id": "Int32", "chunk_id": "Int64", "queries": "Int32", "cut": "boolean"})

    return admit


def connection_graphs(corpus: Corpus, starts: DataFrame, options: GraphOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """The walks of all starts (start_id, path), ids being their own.

    Nodes: (start_id, id, parent_id, depth, score, chunk_id, path, heading, snippet), in the order they were admitted from id 0. Stats, a row for
    each start with seeds: (start_id, total_nodes, knn_queries, seeds_used, max_seed_chunks, max_nodes), the last two being what was cut. A
    start without a chunk that has a vector has no rows. The driver holds the questions of a level in blocks, as any search does.
    """
    o, spark = options or GraphOptions(), corpus.chunks.sparkSession
    plain_unions(spark)
    starts = starts.select("start_id", "path")
    every = durable(seeds(corpus, starts, o.max_seeds), "seeds")
    own, none = every.where(F.col("at") < o.max_seeds), F.lit(None)
    centroid = o.strategy == "centroid"
    first = own.where(F.col("at") < (min(1, o.max_nodes) if centroid else o.max_nodes))
    nodes = first.select("start_id", F.col("at").cast("int").alias("id"), none.cast("int").alias("parent_id"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"), "chunk_id", "path")
    barred = own.select("start_id", "chunk_id") if centroid else None
    steps: list[DataFrame] = []
    for depth in range(1, o.depth + 1):
        front = nodes.where(F.col("depth") == depth - 1)
        if depth == 1 and centroid:
            asked, queries = front.withColumn("query_id", F.col("start_id")), centroids(own).withColumnRenamed("start_id", "query_id")
        else:
            asked = front.withColumn("query_id", F.col("chunk_id"))
            queries = corpus.vectors.join(front.select("chunk_id").distinct(), "chunk_id").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
        found = durable(_neighbours(corpus, queries, o), "neighbours")
        met = asked.select("start_id", "id", "query_id").join(found, "query_id").select("start_id", F.lit(2).alias("kind"), "id", none.cast("int").alias("depth"), "chunk_id", "path", "rank", "distance")
        state = nodes.select("start_id", F.lit(0).alias("kind"), "id", "depth", "chunk_id", "path", none.cast("int").alias("rank"), none.cast("double").alias("distance"))
        if barred is not None:
            state = state.unionByName(barred.select("start_id", F.lit(1).alias("kind"), none.cast("int").alias("id"), none.cast("int").alias("depth"), "chunk_id", none.cast("string").alias("path"), none.cast("int").alias("rank"), none.cast("double").alias("distance")))
        step = durable(state.unionByName(met).groupBy("start_id").applyInPandas(_admitting(o, depth), _STEP), "level")
        steps.append(step.where("id is null"))
        nodes = nodes.unionByName(step.where("id is not null").select(*nodes.columns))
    snippet = F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("…"))).otherwise(F.col("content"))
    shown = nodes.join(corpus.chunks.select(F.col("id").alias("chunk_id"), "heading", snippet.alias("snippet")), "chunk_id", "left")
    counted = own.groupBy("start_id").agg(F.count("*").alias("n"))
    more = every.where(F.col("at") == o.max_seeds).select("start_id", F.lit(True).alias("more"))
    size = nodes.groupBy("start_id").agg(F.count("*").alias("total_nodes"))
    asked = spark.createDataFrame([], "start_id long, queries int, cut boolean")
    for step in steps:
        asked = asked.union(step.select("start_id", "queries", "cut"))
    asked = asked.groupBy("start_id").agg(F.sum("queries").alias("queries"), F.bool_or("cut").alias("cut"))
    used = F.when(F.lit(o.max_nodes == 0), 0).when(F.lit(centroid), F.col("n")).otherwise(F.least("n", F.lit(o.max_nodes)))
    cut = F.coalesce("cut", F.lit(False)) | F.lit(o.max_nodes == 0) | (F.lit(not centroid) & (F.col("n") > o.max_nodes))
    stats = counted.join(size, "start_id", "left").join(asked, "start_id", "left").join(more, "start_id", "left")
    stats = stats.select("start_id", F.coalesce("total_nodes", F.lit(0)).alias("total_nodes"), F.coalesce("queries", F.lit(0)).cast("long").alias("knn_queries"), used.cast("long").alias("seeds_used"), F.coalesce("more", F.lit(False)).alias("max_seed_chunks"), cut.alias("max_nodes"))
    return shown.select("start_id", "id", "parent_id", "depth", "score", "chunk_id", "path", "heading", "snippet"), stats


def connection_graph(corpus: Corpus, path: str, options: GraphOptions | None = None) -> Graph:
    """The walk of one document, which has at most max_nodes nodes, fetched for rendering."""
    starts = corpus.chunks.sparkSession.createDataFrame([(0, path)], "start_id long, path string")
    nodes, stats = connection_graphs(corpus, starts, options)
    rows = [Node(*r[1:]) for r in nodes.orderBy("id").collect()]
    s = stats.first()
    if s is None:
        return Graph()
    return Graph(rows, s["knn_queries"], s["seeds_used"], [n for n in ("max_seed_chunks", "max_nodes") if s[n]])


def _label(n: Node, most: int = 40) -> str:
    text = n.heading or n.path.rsplit("/", 1)[-1]
    return text if len(text) <= most else text[: most - 1] + "…"


def to_json(graph: Graph) -> str:
    drop = lambda d: {k: v for k, v in d.items() if v is not None}
    return json.dumps({"nodes": [drop(asdict(n)) for n in graph.nodes], "stats": {"total_nodes": len(graph.nodes), "knn_queries": graph.knn_queries, "seeds_used": graph.seeds_used}, "truncation": graph.truncation}, ensure_ascii=False)


def to_text(graph: Graph) -> str:
    return "\n".join(f"{'  ' * n.depth}- {n.path} {n.heading or ''} ({n.score:.3f})".rstrip() for n in graph.nodes)


def to_dot(graph: Graph) -> str:
    safe = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ")
    lines = ["digraph connections {", "  rankdir=LR;"]
    lines += [f'  n{n.id} [label="{safe(_label(n))}"];' for n in graph.nodes]
    lines += [f'  n{n.parent_id} -> n{n.id} [label="{n.score:.2f}"];' for n in graph.nodes if n.parent_id is not None]
    return "\n".join([*lines, "}"])


def to_svg(graph: Graph) -> str:
    """A tree from left to right: leaves in order below each other, parents beside the middle of their children."""
    safe = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    children: dict[int | None, list[int]] = defaultdict(list)
    for n in graph.nodes:
        children[n.parent_id].append(n.id)
    y: dict[int, float] = {}
    line = 0
    for n in reversed(graph.nodes):  # children come after parents
        if children[n.id]:
            y[n.id] = sum(y[c] for c in children[n.id]) / len(children[n.id])
        else:
            y[n.id], line = float(line), line + 1
    x = lambda n: 20 + n.depth * 300
    top = lambda i: 20 + y[i] * 54
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{60 + 300 * (1 + max((n.depth for n in graph.nodes), default=0))}" height="{40 + 54 * max(line, 1)}">']
    for n in graph.nodes:
        if n.parent_id is not None:
            p = graph.nodes[n.parent_id]
            out.append(f'<line x1="{x(p) + 240}" y1="{top(p.id) + 20:.1f}" x2="{x(n)}" y2="{top(n.id) + 20:.1f}" stroke="#888"/>')
    for n in graph.nodes:
        out.append(f'<rect x="{x(n)}" y="{top(n.id):.1f}" width="240" height="40" fill="#eef" stroke="#558"/><text x="{x(n) + 8}" y="{top(n.id) + 25:.1f}" font-size="12">{safe(fit_width(n.heading or n.path.rsplit("/", 1)[-1], 12, 224))}</text>')
    return "".join([*out, "</svg>"])
