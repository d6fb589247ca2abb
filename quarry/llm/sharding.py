"""Sharding by a permutation-filled lookup table: constant-time placement that changes little when shards come or go."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.durable import as_id

#: Slots of the table, a prime; at least a hundred for each shard keep the shares within a few hundredths.
SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def fill_table(shards: list[str] | tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """slots entries, each the index of a shard. The shards take turns; each claims the next free slot in its own order of preference,
    a walk from a hashed offset by a hashed step over the prime number of slots."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)) or slots < len(shards):
        raise ValueError("slots must be a prime of at least the number of shards")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo slots. A null key takes the slot of the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def assign_shards(rows: DataFrame, key_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with slot and shard added (columns of these names are replaced). The table has `slots` rows whatever the input, and is broadcast."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, shards[s]) for k, s in enumerate(fill_table(shards, slots))], "slot int, shard string")
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in ("slot", "shard")]
    out = rows.select(*rest, slot_of(F.col(f"`{key_col}`"), slots).alias("slot"))  # the key may be one of the replaced columns
    return out.join(F.broadcast(table), "slot")


def write_shards(rows: DataFrame, path: str, key_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, parts: int = 1) -> None:
    """Writes rows under path/shard=<name>, each shard by `parts` tasks, so that a large shard needs no large task."""
    out = assign_shards(rows, key_col, shards)
    salt = F.pmod(F.xxhash64(as_id(key_col)), F.lit(parts))
    out.repartition(len(shards) * parts, "shard", salt).write.partitionBy("shard").parquet(path)
