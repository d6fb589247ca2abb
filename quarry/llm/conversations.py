"""Structure repair of conversations: the cheapest edits that make the roles of each one alternate, and what was wrong with it.

A conversation of at most LONG rows is one product of its turns' matrices in one task. A longer one is cut: its rows are numbered in order,
runs of LONG numbers become one matrix each, and a tree of products, FAN at a time, brings the runs of all partitions together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.durable import BROADCAST_IDS, as_id, durable, keep_ids, release_memory, small_batches
from quarry.llm.turn_matrix import CLOSED, Roles, apply, ends, matrix_of, product, repaired
from quarry.storage import numbered

#: Rows of a conversation that one task holds, and of a run of a longer one; bytes of such a conversation's texts. Matrices that are multiplied at a time.
LONG, LONG_BYTES, FAN = 256, 8 << 20, 16
_BLANK, _CUT = r"^[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows with damage done to them by crc32(conv_id:turn) % 20, nulls in the key, role and text
    read as one space: 0 drops the row (no copies), 1 empties its text, 2 takes its . ! and ? away, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def plain(rows: DataFrame) -> DataFrame:
    """Rows as they are, nulls in role and text read as one space."""
    return rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))


def _fault(text: Column, duplicate: Column) -> Column:
    """b blank, d duplicate, t truncated, - none: the first of them."""
    return F.when(text.rlike(_BLANK), "b").when(duplicate, "d").when(~text.rlike(_CUT), "t").otherwise("-")


def kind_of(role: str, fault: str) -> str:
    return (role[:1] if role[:1] in ("s", "u", "a") else "?") + ("x" if fault in "bd" else fault)


def illegal(before: str | None, after: str) -> bool:
    return before is not None and before + after not in ("su", "ua", "au")


class _Tally:
    """What is counted along rows in order: faults, turns, illegal neighbours. Two tallies of adjoining rows add up."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # turns that are not null
        self.opens = self.closes = None  # initials

    def add(self, turn: int | None, role: str, fault: str) -> None:
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        self.illegal += illegal(self.closes, role[:1])
        self.opens, self.closes = role[:1] if self.opens is None else self.opens, role[:1]
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn

    def join(self, other: _Tally) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.illegal += other.opens is not None and illegal(self.closes, other.opens)
        self.turns -= self.last is not None and self.last == other.first
        self.opens, self.closes = (other.opens if self.opens is None else self.opens), (self.closes if other.closes is None else other.closes)
        self.first, self.last = (other.first if self.first is None else self.first), (self.last if other.last is None else other.last)

    def row(self) -> list:
        return [0 if self.first is None else self.last - self.first + 1 - self.turns, self.blank, self.duplicate, self.truncated, self.illegal]


def _batch(rows: list[list], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(columns)], names=[n for n, _ in columns])


def _digest(lines: Iterator[str]) -> str:
    out, first = hashlib.sha256(), True
    for line in lines:
        out.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
        first = False
    return out.hexdigest()


def _whole(conv_id: int | None, rows: list[tuple]) -> list:
    """The result of a conversation whose rows (turn, role, text, copies, blank, cut) are at hand in order."""
    tally, seen, kinds, live = _Tally(), set(), [], []
    for turn, role, text, copies, blank, cut in rows:
        for _ in range(copies):
            fault = "b" if blank else "d" if (role, text) in seen else "t" if cut else "-"
            seen.add((role, text))
            tally.add(turn, role, fault)
            kinds.append(kind_of(role, fault))
            live.append((role, text))
    cost, audit = repaired(tuple(kinds))
    walk = Roles(audit)

    def lines() -> Iterator[str]:
        for role, text in live:
            yield from walk.lines(role, text)
        yield from walk.inserts()

    return [conv_id, *tally.row(), cost, audit, _digest(lines())]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose rows come one after another, each one's in order."""
    conv, rows, out = None, [], []
    for batch in batches:
        for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and conv_id != conv:
                out.append(_whole(conv, rows))
                rows = []
            conv = conv_id
            rows.append(tuple(row))
            if len(out) == 1024:
                yield _batch(out, _RESULT)
                out = []
    if rows:
        out.append(_whole(conv, rows))
    yield _batch(out, _RESULT)
    release_memory()


_ORDER = ("turn", "role", "text")  # nulls first, as Spark sorts them; exact repeats are alike
_NODE = "conv_id long, place long, blank long, duplicate long, truncated long, illegal long, turns long, first long, last long, opens string, closes string"
_ENTRIES = ", ".join(f"c{i}{j} long, a{i}{j} string" for i in range(4) for j in range(4))


def _node(row: list, tally: _Tally, matrix) -> list:
    flat = [x for r in matrix for e in r for x in (e or (None, None))]
    return [*row, tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.turns, tally.first, tally.last, tally.opens, tally.closes, *flat]


def _read_node(row: dict):
    tally = _Tally()
    for name in ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "opens", "closes"):
        setattr(tally, name, row[name])
    return tally, tuple(tuple((row[f"c{i}{j}"], row[f"a{i}{j}"]) if row[f"a{i}{j}"] is not None else None for j in range(4)) for i in range(4))


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node for each run of rows (conv_id, place, [(pos, turn, role, fault)])."""
    for batch in batches:
        out = []
        for conv_id, place, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tally, kinds = _Tally(), []
            for r in rows:
                tally.add(r["turn"], r["role"], r["fault"])
                kinds.append(kind_of(r["role"], r["fault"]))
            out.append(_node([conv_id, place], tally, matrix_of(kinds)))
        yield _batch(out, f"{_NODE}, {_ENTRIES}")
    release_memory()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One node for each run of nodes (conv_id, place, [node])."""
    for batch in batches:
        for k in range(batch.num_rows):
            conv_id, place, nodes = (c[k].as_py() for c in batch.columns)
            tally, matrix = _read_node(nodes[0])
            for n in nodes[1:]:
                more, right = _read_node(n)
                tally.join(more)
                matrix = product(matrix, right)
            yield _batch([_node([conv_id, place], tally, matrix)], f"{_NODE}, {_ENTRIES}")
    release_memory()


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results, but for the digest, of conversations that are one node each."""
    for batch in batches:
        for r in batch.to_pylist():
            tally, matrix = _read_node(r)
            cost, audit = ends(apply(CLOSED[0], matrix))
            yield _batch([[r["conv_id"], *tally.row(), cost, audit, None]], _RESULT)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of rows (conv_id, audit, role, text) in order, whose first one of a conversation has its audit."""
    conv, walk, digest, first = None, None, None, True

    def put(lines: list[str]) -> None:
        nonlocal first
        for line in lines:
            digest.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
            first = False

    def done() -> pa.RecordBatch:
        put(walk.inserts())
        return _batch([[conv, digest.hexdigest()]], "conv_id long, repaired_sha256 string")

    for batch in batches:
        for conv_id, audit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is not None:
                if walk is not None:
                    yield done()
                conv, walk, digest, first = conv_id, Roles(audit), hashlib.sha256(), True
            else:
                put(walk.lines(role, text))
    if walk is not None:
        yield done()
    release_memory()


def _long(rows: DataFrame, long_rows: int) -> DataFrame:
    """Results of conversations of any length; each row has to be one copy."""
    ordered = numbered(rows.select(F.struct("conv_id", *_ORDER).alias("at")), "at", "pos", first=0).select("pos", *(F.col(f"at.{c}").alias(c) for c in ("conv_id", *_ORDER)))
    said = F.sha2(F.concat_ws("\0", F.col("conv_id").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    seen = ordered.groupBy(said.alias("said"), F.col("conv_id").isNull().alias("none")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh"))
    faults = ordered.join(seen, "pos", "left").select("pos", "conv_id", "turn", F.substring("role", 1, 1).alias("role"), _fault(F.col("text"), F.col("fresh").isNull()).alias("fault"))
    group = faults.groupBy("conv_id", F.floor(F.col("pos") / long_rows).alias("place"))  # at most long_rows rows each
    leaves = group.agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "role", "fault"))).alias("rows"))
    nodes = durable(leaves.mapInArrow(_leaves, f"{_NODE}, {_ENTRIES}"), "turn-matrices")
    while nodes.groupBy("conv_id").count().where("count > 1").limit(1).count():
        fields = F.struct("place", *(c for c in nodes.columns if c not in ("conv_id", "place")))
        level = nodes.groupBy("conv_id", F.floor(F.col("place") / FAN).alias("up")).agg(F.array_sort(F.collect_list(fields)).alias("nodes"))
        nodes = durable(level.mapInArrow(_joined, f"{_NODE}, {_ENTRIES}"), "turn-matrices")
    settled = durable(nodes.mapInArrow(_settled, _RESULT), "audits")
    heads = settled.select("conv_id", F.lit(-1).cast("long").alias("pos"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    tails = ordered.select("conv_id", "pos", F.lit(None).cast("string").alias("audit"), "role", "text")
    stream = heads.unionByName(tails).repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "audit", "role", "text")
    digests = stream.mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    same = settled["conv_id"].eqNullSafe(digests["conv_id"])
    return settled.drop("repaired_sha256").join(digests, same).select(settled["conv_id"], *(c for c in settled.columns if c not in ("conv_id", "repaired_sha256")), "repaired_sha256")


def repair_conversations(turns: DataFrame, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_rows: int = LONG) -> DataFrame:
    """One row for each conversation id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows of an id are taken by turn, nulls first, then role and text. Faults, edits and their costs are as turn_matrix and _fault() state; audit has
    one letter for each edit: K kept, R another role, D deleted, I inserted. damage first harms the rows as damaged() says. A null id is a
    conversation too; null roles and texts read as one space; exact repeats are duplicates; other columns are ignored. An id all whose rows
    damage drops has zeros, an empty audit and the digest of nothing; an empty table gives no row.

    A conversation over long_rows rows or LONG_BYTES passes as runs and a tree of products, so no task holds it but for its audit, which
    has a letter for each edit; sixteen of them while runs are joined. Its digest is sequential by nature: one task reads its rows as a sorted stream.
    """
    spark = turns.sparkSession
    small_batches(spark)
    rows = turns.select(as_id(F.col(f"`{conv_col}`")).alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *(F.col(f"`{c}`").cast("string").alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    rows = damaged(rows) if damage else plain(rows)
    sizes = durable(rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text")).alias("bytes")), "conversations")
    large = durable(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > LONG_BYTES)).select("conv_id"), "long-conversations")
    known = {r["none"] for r in large.select(F.col("conv_id").isNull().alias("none")).distinct().collect()}
    some, null_large, is_null = False in known, True in known, F.col("conv_id").isNull()
    live = rows.where("copies > 0")
    short = live.join(F.broadcast(large) if large.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else large, "conv_id", "left_anti") if some else live
    short = short.where(~is_null) if null_large else short
    facts = short.select("conv_id", *_ORDER, "copies", F.col("text").rlike(_BLANK).alias("blank"), (~F.col("text").rlike(_CUT)).alias("cut"))
    bare = sizes.where("n = 0").select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), F.lit(True).alias("blank"), F.lit(True).alias("cut"))
    out = facts.unionByName(bare).repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER).mapInArrow(_walk, _RESULT)
    if some or null_large:
        parts = [keep_ids(live, large, "conv_id")] if some else []
        parts += [live.where(is_null)] if null_large else []
        rest = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rest = rest.select("conv_id", *_ORDER, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
        out = out.unionByName(_long(rest, long_rows))
    return out.withColumnRenamed("conv_id", conv_col)
