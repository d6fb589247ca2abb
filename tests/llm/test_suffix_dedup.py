import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import suffix_dedup as S
from quarry.llm.suffix_sort import Suffixes


def brute(docs):
    """{id: (bytes, removed, spans, sha256)}, by a set of all windows."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        cut = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                cut[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cut) if not c)
        spans = sum(1 for k in range(len(cut)) if cut[k] and (k == 0 or not cut[k - 1]))
        out[i] = (len(raw), sum(cut), spans, hashlib.sha256(kept).hexdigest())
    return out


def made(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(k) for k in (12, 18, 25, 40, 90)]
    docs = []
    for i in range(n):
        parts = [r.choice([prose(r.randint(1, 30)), r.choice(passages), r.choice(passages)[r.randint(0, 30) :], "ab" * r.randint(1, 90)]) for _ in range(r.randint(1, 5))]
        docs.append((i, " ".join(parts)))
    docs += [(n, docs[3][1]), (n + 1, docs[3][1] + "x"), (n + 2, ""), (n + 3, None), (n + 4, "z" * 500), (n + 5, "y" * 99), (n + 6, "y" * 99)]
    return docs


def rows(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_equals_brute_force(spark):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(S.remove_repeats(df, texts=False)) == brute(docs)


def in_process(docs, size, buckets=3):
    """The same steps without Spark, in batches of `size` documents."""
    found, at = [], defaultdict(list)
    for k in range(0, len(docs), size):
        part = docs[k : k + size]
        batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in part]), pa.array([d[1] for d in part], pa.string())], names=["id", "text"])
        for b in S._find_runs(buckets)(iter([batch])):
            for r in b.to_pylist():
                at[r["bucket"]].append(r)
    for part in at.values():
        found += S._meet_group((), pa.Table.from_pylist(part, pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("mark", pa.int64()), ("blob", pa.binary())]))).to_pylist()
    spans, opened = defaultdict(list), defaultdict(list)
    for r in found:
        (spans if r["kind"] == 1 else opened)[r["id"], r["mark"]].append(r["blob"])
    texts, groups = dict(docs), defaultdict(list)
    keys = sorted(opened)
    for k in range(0, len(keys), size):
        part = keys[k : k + size]
        import zstandard

        batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in part]), pa.array([p[1] for p in part]), pa.array([zstandard.compress((texts[p[0]] or "").encode()) for p in part]), pa.array([opened[p] for p in part])], names=["id", "mark", "packed", "blobs"])
        for b in S._slice_rows(iter([batch])):
            for r in b.to_pylist():
                groups[r["key"] % buckets].append(r)
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("mark", pa.int64()), ("blob", pa.binary()), ("key", pa.int64()), ("pos", pa.int64()), ("lead", pa.int32())])
    for part in groups.values():
        for r in S._meet_slice_group((), pa.Table.from_pylist(part, schema)).to_pylist():
            spans[r["id"], r["mark"]].append(r["blob"])
    out = {}
    for i, text in docs:
        raw = (text or "").encode()
        cut = np.frombuffer(b"".join(spans.get((i, S._mark(raw)), [])), np.int64).reshape(-1, 2)
        cut = S._merged(cut[:, 0], cut[:, 1])
        gone = {x for a, b in cut.tolist() for x in range(a, b)}
        kept = bytes(c for k, c in enumerate(raw) if k not in gone)
        out[i] = (len(raw), len(gone), len(cut), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [0, 1, 48])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_frequent_anchors_by_single_windows(monkeypatch, frequent, size):
    monkeypatch.setattr(S, "FREQUENT", frequent)
    docs = made(2, 40)
    assert in_process(docs, size) == brute(docs)


def test_edge_cases(spark):
    a, b = "q" * 50 + "".join(chr(97 + k % 26) for k in range(150)), "0123456789" * 12
    docs = [(1, a, "x", 5), (1, a, "y", 5), (2, a, None, None), (None, a, "z", 1), (3, None, "n", 0), (4, "é" * 49 + "!", "k", 0), (5, b + b, "l", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string, id int")
    out = S.remove_repeats(df).collect()
    assert len(out) == len(docs) and set(df.columns) <= set(out[0].asDict())
    by = {(r["doc_id"], r["kept"]): r for r in out}
    assert by[1, "x"]["n_removed"] == by[1, "y"]["n_removed"] and by[None, "z"]["n_removed"] == 0
    assert by[2, None]["n_removed"] == len(a) and by[2, None]["text"] == ""
    assert by[3, "n"]["n_bytes"] == 0 and by[4, "k"]["n_removed"] == 0
    assert by[5, "l"]["n_removed"] == brute([(5, b + b)])[5][1] > 0
    assert S.remove_repeats(df.limit(0)).count() == 0
    assert S.remove_repeats(df.limit(0), texts=False).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_suffix_sort_orders_like_bytes():
    r = random.Random(3)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(700)), np.uint8)
    at = np.arange(0, 640)
    seg = np.array([r.randint(0, 2) for _ in at])
    order = Suffixes(data, 40).sort(at, seg)
    raw = data.tobytes()
    assert [(seg[k], raw[at[k] : at[k] + 40], k) for k in order] == sorted((seg[k], raw[at[k] : at[k] + 40], k) for k in range(len(at)))


def test_collisions_are_verified():
    s = Suffixes(np.frombuffer(b"abcdabceabcd" + b"\0" * 8, np.uint8), 4)
    s.prefix[:] = 0  # every hash collides
    at, seg = np.array([0, 4, 8]), np.zeros(3, np.int64)
    c = s.classes(at, seg)
    assert c[0] != c[1]
