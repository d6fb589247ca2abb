"""Results as text: JSON without nulls, lines for continuous integration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import template_paths


def as_json(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep…, json): every row as a JSON object in which null fields are left out."""
    return rows.select(*keep, F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in keep))).alias("json"))


def search_json(hits: DataFrame) -> DataFrame:
    """(query_id, json): the hits of each query as one object {results, low_confidence}, best first; as many as the search's limit."""
    hit = F.struct("rank", *(c for c in hits.columns if c not in ("query_id", "rank", "low_confidence")))
    found = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("results"), F.bool_or("low_confidence").alias("low_confidence"))
    return as_json(found, ("query_id",))


def check_lines(findings: DataFrame) -> DataFrame:
    """The doctor's findings as lines, errors first; checks that found nothing are left out."""
    shown = findings.where("n > 0").orderBy("severity", "check")
    return shown.select(F.format_string("%s: %s: %d (%s)", "severity", "check", "n", F.array_join("samples", ", ")).alias("line"))


def best_practice(documents: DataFrame, templates: tuple[str, ...], target: str) -> str | None:
    """The path of the first template that a document of the index has."""
    paths = template_paths(templates, target)
    found = {r["path"] for r in documents.where(F.col("path").isin(paths)).select("path").collect()}
    return next((p for p in paths if p in found), None)
