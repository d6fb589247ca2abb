"""Settings from TOML and golden sets from YAML, checked strictly."""

from __future__ import annotations

import tomllib
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession

from quarry.model import Fusion, Mmr, Parent, SearchOptions

MOST_GOLDEN = 1 << 20
_SECTIONS = {"fusion": Fusion, "mmr": Mmr, "parent": Parent}


def _take(kind, table: dict, where: str):
    known = {f.name for f in fields(kind)}
    if unknown := set(table) - known:
        raise ValueError(f"{where}: unknown keys {sorted(unknown)}")
    return kind(**table)


def search_options(text: str) -> SearchOptions:
    """The [search] table: min_confidence_ratio, limit, rerank and the tables fusion, mmr and parent."""
    table = dict(tomllib.loads(text).get("search", {}))
    parts = {k: _take(v, table.pop(k), f"search.{k}") for k, v in _SECTIONS.items() if k in table}
    if unknown := set(table) - {"min_confidence_ratio", "limit", "rerank"}:
        raise ValueError(f"search: unknown keys {sorted(unknown)}")
    return replace(SearchOptions(), **table, **parts)


GOLDEN = "query_id long, query string, expected array<struct<path:string,heading:string>>, tags array<string>"


def golden_defaults(text: str) -> dict:
    """{limit?, rerank?} that a golden set asks to be run with."""
    import yaml

    return dict((yaml.safe_load(text) or {}).get("defaults") or {})


def golden(spark: SparkSession, text: str) -> DataFrame:
    """The queries of a golden set: {defaults?, queries: [{id?, query, expected: [{path, heading?}], tags?}]}. golden_defaults() reads the defaults."""
    import yaml

    if len(text.encode()) > MOST_GOLDEN:
        raise ValueError("a golden set has at most 1 MiB")
    data = yaml.safe_load(text) or {}
    if set(data) - {"defaults", "queries"} or set(data.get("defaults") or {}) - {"limit", "rerank"}:
        raise ValueError("golden set: unknown keys")
    rows = []
    for k, q in enumerate(data.get("queries") or []):
        if set(q) - {"id", "query", "expected", "tags"} or any(set(e) - {"path", "heading"} for e in q.get("expected") or []):
            raise ValueError(f"golden query {k}: unknown keys")
        rows.append((k, q["query"], [(e["path"], e.get("heading")) for e in q.get("expected") or []], q.get("tags") or []))
    return spark.createDataFrame(rows, GOLDEN)
