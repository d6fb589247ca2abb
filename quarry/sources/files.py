"""Scanning a folder of documents: which files count, their hashes, and their parsed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.globs import ignore_regex
from quarry.functions.text import category_of, extension_of, quality_score, token_estimate, topic_of
from quarry.sources.parsers import BINARY, MOST_BYTES, parse, registry

# Folders that are left out unless a list is given, and those that always are.
EXCLUDED = (".obsidian", ".git", "node_modules", "target", ".vscode", ".idea")
ALWAYS_EXCLUDED = (".git", ".svn", "node_modules")
MOST_RULES, MOST_RULE_BYTES = 1000, 64 << 10


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    if len(text.encode()) > MOST_RULE_BYTES or text.count("\n") > MOST_RULES:
        raise ValueError("an ignore file has at most 64 KiB and 1000 patterns")
    return [r for line in text.split("\n") if (r := ignore_regex(line))]


def excluded(path: Column, folders: tuple[str, ...] | None = None, ignore: str = "") -> Column:
    """True for paths under an excluded folder or whose last matching ignore pattern does not take them back.

    folders replaces the default list, () excludes nothing of it; the folders that are always left out stay so.
    """
    barring = (*ALWAYS_EXCLUDED, *(EXCLUDED if folders is None else folders))
    low = F.lower(path)
    barred = F.arrays_overlap(F.slice(F.split(low, "/"), 1, F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0))), F.array(*(F.lit(x.lower()) for x in barring)))
    matched = F.lit(False)
    for pattern, back in ignore_rules(ignore):
        matched = F.when(low.rlike(pattern), F.lit(not back)).otherwise(matched)
    return barred | matched


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md",), folders: tuple[str, ...] | None = None, ignore: str = "", cap: int = MOST_BYTES, only: list[str] | None = None) -> DataFrame:
    """(path, content_hash, size_bytes, status, content) of the eligible files under root; those over the cap have status oversize and no content.

    only: files under root that are there, by path; just these are looked at."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(root) if only is None else reader.load([f"{root}/{p}" for p in only]) if only else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace("path", r"^.*?" + base.replace(".", r"\.") + "/", "")
    rows = files.withColumn("path", path).where(extension_of(F.col("path")).isin(*extensions) & ~F.regexp_extract("path", r"([^/]*)$", 1).startswith("~$") & ~excluded(F.col("path"), folders, ignore))
    small = F.col("length") <= cap
    good = rows.where(small).select("path", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), F.lit("ok").alias("status"), "content")
    over = rows.where(~small).select("path", F.lit(None).cast("string").alias("content_hash"), F.col("length").alias("size_bytes"), F.lit("oversize").alias("status"), F.lit(None).cast("binary").alias("content"))
    return good.unionByName(over)


_CHUNK = "struct<index:int,heading:string,level:int,content:string,context:string>"
PARSED = f"path string, error string, title string, date string, topic string, depth string, tags array<string>, chunks array<{_CHUNK}>"


def parsed(files: DataFrame, enabled: tuple[str, ...] = ("md",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """A row for each file (path, content), with its metadata and chunks, or an error."""
    parsers = registry(enabled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                error, p = parse(bytes(raw or b""), path, parsers, exclude)
                out.append((path, error, *((p.title, p.date, p.topic, p.depth, p.tags, [vars(c) for c in p.chunks]) if p else (None, None, None, None, [], []))))
            yield pd.DataFrame(out, columns=["path", "error", "title", "date", "topic", "depth", "tags", "chunks"])

    return files.select("path", "content").mapInPandas(run, PARSED)


def chunk_rows(documents: DataFrame) -> DataFrame:
    """(path, category, topic, chunk_index, heading, level, content, context_text, token_count, quality_score) of parsed files."""
    rows = documents.where("error is null").select("path", category_of(F.col("path")).alias("category"), F.coalesce("topic", topic_of(F.col("path"))).alias("topic"), F.explode("chunks").alias("c"))
    binary = extension_of(F.col("path")).isin(*BINARY)
    return rows.select("path", "category", "topic", F.col("c.index").alias("chunk_index"), "c.heading", "c.level", "c.content", F.col("c.context").alias("context_text"), token_estimate(F.col("c.content")).alias("token_count"), quality_score(F.col("c.content"), binary).alias("quality_score"))


def document(raw: DataFrame, path: str, cap: int = 1 << 20) -> tuple[str, bool] | None:
    """(text, whether it was cut) of one document of (path, content); None where there is none."""
    from quarry.functions.text import truncate_bytes

    row = raw.where(F.col("path") == path).select(F.substring("content", 1, cap + 1).alias("c"), F.octet_length("content").alias("n")).limit(1).collect()
    return (truncate_bytes(bytes(row[0]["c"]).decode("utf-8", "ignore"), cap), row[0]["n"] > cap) if row else None
