"""Integrity checks, status, topics and rules for metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import extension_of, group_prefix
from quarry.model import QUALITY, Corpus
from quarry.storage import durable

SAMPLES = 5


def orphans(corpus: Corpus, postings: DataFrame | None = None) -> dict[str, DataFrame]:
    """check id to rows (label) that it found. postings: (chunk_id) of an external text index, if there is one."""
    chunks, docs, vecs = corpus.chunks.select("id", "document_id"), corpus.documents.select("id", "path"), corpus.vectors.select("chunk_id")
    label = lambda df, c: df.select(F.col(c).cast("string").alias("label"))
    out = {
        "missing-embedding": label(chunks.join(vecs, chunks["id"] == vecs["chunk_id"], "left_anti"), "id"),
        "orphan-embedding": label(vecs.join(chunks, chunks["id"] == vecs["chunk_id"], "left_anti"), "chunk_id"),
        "chunk-without-document": label(chunks.join(docs.withColumnRenamed("id", "d"), F.col("document_id") == F.col("d"), "left_anti"), "id"),
        "document-without-chunks": label(docs.join(chunks.select("document_id"), docs["id"] == F.col("document_id"), "left_anti"), "path"),
    }
    none = vecs.limit(1).agg(F.count("*").alias("v")).where("v = 0")  # vectors of no chunk at all are a finding of its own
    out["vector-table-missing"] = chunks.agg(F.count("*").alias("n")).where("n > 0").crossJoin(none).select(F.concat(F.col("n").cast("string"), F.lit(" chunks")).alias("label"))
    if postings is not None:
        out["missing-text-row"] = label(chunks.join(postings, chunks["id"] == postings["chunk_id"], "left_anti"), "id")
        out["orphan-text-row"] = label(postings.join(chunks, chunks["id"] == postings["chunk_id"], "left_anti"), "chunk_id")
    return out


def warnings(corpus: Corpus, extensions: tuple[str, ...] = ("md",), cap: int = 1 << 20, excluded: str | None = None) -> dict[str, DataFrame]:
    docs = corpus.documents.select(F.col("path").alias("label"), "size_bytes")
    out = {
        "extension-not-registered": docs.where(~extension_of(F.col("label")).isin(*extensions)).select("label"),
        "larger-than-a-read-returns": docs.where(F.col("size_bytes") > cap).select("label"),
        "size-not-recorded": docs.where(F.col("size_bytes").isNull()).select("label"),
    }
    if excluded is not None:
        out["indexed-despite-exclusion"] = docs.where(F.lower("label").rlike(excluded)).select("label")
    return out


def doctor(corpus: Corpus, postings: DataFrame | None = None, extensions: tuple[str, ...] = ("md",), cap: int = 1 << 20, excluded: str | None = None) -> DataFrame:
    """(check, severity, n, samples): a row for each check, with the first five labels. What all checks found is stored once, then counted and sampled.

    vector-table-missing has a row only where there are chunks and no vectors at all."""
    found = [(k, "error", v) for k, v in orphans(corpus, postings).items()] + [(k, "warning", v) for k, v in warnings(corpus, extensions, cap, excluded).items()]
    rows = durable(reduce(DataFrame.union, [v.select(F.lit(k).alias("check"), F.col("label")) for k, _, v in found]), "findings")
    counts = rows.groupBy("check").agg(F.count("*").alias("n"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("check").orderBy("label"))).where(F.col("r") <= SAMPLES)
    samples = first.groupBy("check").agg(F.sort_array(F.collect_list("label")).alias("samples"))
    known = rows.sparkSession.createDataFrame([(k, s) for k, s, _ in found], "check string, severity string")
    out = known.join(counts, "check", "left").join(samples, "check", "left")
    out = out.where((F.col("check") != "vector-table-missing") | F.col("n").isNotNull())
    return out.select("check", "severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def status(corpus: Corpus, threshold: float = QUALITY) -> DataFrame:
    """One row of counts."""
    q, null = F.col("quality_score"), F.coalesce(F.trim("context_text"), F.lit(""))
    c = corpus.chunks.agg(F.count("*").alias("chunks"), F.count_if(null != "").alias("with_context"), F.count_if(q >= threshold).alias("good"), F.count_if(q < threshold).alias("poor"))
    return corpus.documents.agg(F.count("*").alias("documents"), F.count_if(F.col("size_bytes").isNull()).alias("without_size")).crossJoin(c)


def topics(documents: DataFrame) -> DataFrame:
    """(category, topic, documents, last_indexed); nulls form groups."""
    return documents.groupBy("category", "topic").agg(F.count("*").alias("documents"), F.max("last_indexed").alias("last_indexed")).orderBy("category", "topic")


def topic_titles(documents: DataFrame) -> DataFrame:
    """(category, topic, title): the listing of the topics, a row for each title; null titles are dropped."""
    return documents.where("title is not null").select("category", "topic", "title").orderBy("category", "topic", "title")


def topic_groups(documents: DataFrame) -> DataFrame:
    return documents.groupBy(group_prefix(F.col("path")).alias("prefix")).agg(F.count("*").alias("documents"))


def group_paths(documents: DataFrame) -> DataFrame:
    """(prefix, path): the listing of the groups, a row for each path."""
    return documents.select(group_prefix(F.col("path")).alias("prefix"), "path")


FIELDS = ("title", "date", "topic", "depth", "tags")


@dataclass(frozen=True)
class FieldRule:
    name: str
    required: bool = False
    type: str | None = None
    pattern: str | None = None
    enum: tuple[str, ...] = ()
    min_length: int | None = None
    max_length: int | None = None
    allow_empty: bool = False

    def __post_init__(self) -> None:
        if self.name not in FIELDS:
            raise ValueError(f"unknown field {self.name}; known: {', '.join(FIELDS)}")
        if self.type not in (None, "string", "array"):
            raise ValueError("type is string or array")
        if self.pattern is not None:
            if self.name == "tags" or self.type == "array":
                raise ValueError("a pattern needs a string field")
            re.compile(self.pattern)
        if self.min_length is not None and self.max_length is not None and self.min_length > self.max_length:
            raise ValueError("min_length is over max_length")


def _violations(rule: FieldRule) -> list[Column]:
    """A null string is no value, an empty one is; null tags are an empty list. A wrong type tells of nothing else; neither does a missing value."""
    array = rule.name == "tags"
    value = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if array else F.col(rule.name)
    size = F.size(value) if array else F.length(value)
    problem = lambda test, kind, text: F.when(test, F.struct(F.lit(rule.name).alias("field"), F.lit(kind).alias("kind"), F.lit(text).alias("detail")))
    if rule.type is not None and (rule.type == "array") != array:
        return [problem(F.lit(True), "type", rule.type)]
    blank = (size == 0) & F.lit(rule.required and not rule.allow_empty)
    missing = blank if array else F.when(value.isNull(), F.lit(rule.required)).otherwise(blank)
    out = [problem(missing, "missing", "required")]
    live = ~missing & value.isNotNull()
    if rule.min_length is not None:
        out.append(problem(live & (size < rule.min_length), "length", f"min {rule.min_length}"))
    if rule.max_length is not None:
        out.append(problem(live & (size > rule.max_length), "length", f"max {rule.max_length}"))
    if rule.pattern is not None:
        out.append(problem(live & ~value.rlike(rule.pattern), "pattern", rule.pattern))
    if rule.enum and not array:
        out.append(problem(live & ~value.isin(*rule.enum), "enum", "|".join(rule.enum)))
    return out


def _tag_violations(rule: FieldRule) -> Column:
    """One for each tag outside the enum."""
    bad = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda x: ~x.isin(*rule.enum))
    return F.transform(bad, lambda x: F.struct(F.lit("tags").alias("field"), F.lit("enum").alias("kind"), F.lit("|".join(rule.enum)).alias("detail")))


def validate(documents: DataFrame, rules: tuple[FieldRule, ...]) -> DataFrame:
    """(path, field, kind, detail) of each broken rule: missing, type, pattern, enum or length."""
    found = F.array_compact(F.array(*(v for r in rules for v in _violations(r))))
    for r in rules:
        if r.name == "tags" and r.enum and r.type != "string":
            found = F.concat(found, _tag_violations(r))
    return documents.select("path", F.explode(found).alias("v")).select("path", "v.field", "v.kind", "v.detail")


def github_lines(violations: DataFrame) -> DataFrame:
    return violations.select(F.format_string("::error file=%s::%s %s: %s", "path", "field", "kind", "detail").alias("line"))
