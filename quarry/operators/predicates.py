"""Metadata filters as predicates over rows that carry document and chunk columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.globs import glob_regex
from quarry.functions.text import extension_of
from quarry.model import Filters


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def globs_match(path: Column, globs: tuple[str, ...]) -> Column:
    """Passes with no positive glob or one that matches, and no !glob that matches."""
    wanted = [path.rlike(glob_regex(g)) for g in globs if not g.startswith("!")]
    barred = [path.rlike(glob_regex(g[1:])) for g in globs if g.startswith("!")]
    return (_any(wanted) if wanted else F.lit(True)) & (~_any(barred) if barred else F.lit(True))


def predicate(f: Filters) -> Column:
    """True for rows that pass; never null. A null date fails any date bound; bounds compare as text and include their ends."""
    tests = [F.lit(True)]
    if f.threshold > 0:
        tests.append(F.col("quality_score") >= f.threshold)
    if f.category is not None:
        tests.append(F.col("category") == f.category)
    if f.topic is not None:
        tests.append(F.col("topic") == f.topic)
    if f.path_globs:
        tests.append(globs_match(F.col("path"), f.path_globs))
    if f.tags_any:
        tests.append(F.arrays_overlap("tags", F.array(*map(F.lit, f.tags_any))))
    if f.tags_all:
        tests.append(F.size(F.array_except(F.array(*map(F.lit, f.tags_all)), "tags")) == 0)
    if f.date_from is not None:
        tests.append(F.col("date") >= f.date_from)
    if f.date_to is not None:
        tests.append(F.col("date") <= f.date_to)
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def too_large(documents: DataFrame, cap: int) -> DataFrame:
    """Documents over the cap by path; an unrecorded size is not too large."""
    return documents.where(F.col("size_bytes") > cap).orderBy("path")


def servable(documents: DataFrame, extensions: tuple[str, ...], cap: int) -> DataFrame:
    return documents.where(extension_of(F.col("path")).isin(*extensions) & F.col("size_bytes").isNotNull() & (F.col("size_bytes") <= cap))
