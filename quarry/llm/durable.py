"""Cutting lineage with tables in the shared checkpoint folder, and joins that broadcast only what was counted first."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.storage import durable, shared_folder, small_batches

__all__ = ["as_id", "durable", "free_prefix", "keep_ids", "release_memory", "shared_folder", "small_batches"]

#: A table of ids is broadcast only if it has at most this many rows (8 bytes each, 4 MB); larger ones are joined by shuffle.
BROADCAST_IDS = 500_000


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows of df whose column `on` occurs in ids. ids must be durable, as it is counted first."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, on, "left_semi")


def as_id(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


def free_prefix(df: DataFrame, names: Iterable[str]) -> str:
    """A prefix that makes none of the names that of a column of df."""
    taken, prefix = {c.lower() for c in df.columns}, "__"
    while any(f"{prefix}{n}".lower() in taken for n in names):
        prefix += "_"
    return prefix


def release_memory() -> None:
    """Hands freed memory of a Python worker back to the system, Arrow's and the C library's; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
