"""Token counts, lattice samples, decontamination and sharding."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import decontaminate as D
from quarry.llm import sharding, token_counts
from quarry.llm.lattice import Pieces, encode_samples, sample_texts
from quarry.llm.registry import PIECES


def greedy(pieces, word):
    n = at = 0
    longest = max(map(len, pieces), default=0)
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
        n += 1 if size else len(word[at].encode())
        at += max(size, 1)
    return n


def test_automaton_equals_greedy():
    r = random.Random(1)
    for _ in range(40):
        pieces = {"".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(12)}
        a = token_counts.Automaton(sorted(pieces))
        for _ in range(60):
            w = "".join(r.choice("abéz") for _ in range(r.randint(0, 15)))
            assert a.count(w) == greedy(pieces, w)
    assert token_counts.Automaton([]).count("aé") == 3


def test_token_counts(spark, tiny):
    pieces = token_counts.read_pieces(PIECES)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    known, cache = set(pieces), {}
    want = {}
    for r in docs.collect():
        ws = r["text"].split()
        for w in ws:
            cache[w] = cache.get(w) or greedy(known, "▁" + w)
        want[r["doc_id"]] = (len(ws), sum(cache[w] for w in ws))
    assert {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs, pieces).collect()} == want
    odd = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, "", 3), (2, "x" * 5000, 4)], "doc_id long, text string, n_words int")
    got = [(r["doc_id"], r["n_words"]) for r in token_counts.token_counts(odd, pieces).collect()]
    assert sorted(got, key=str) == sorted([(None, 2), (1, 0), (1, 0), (2, 1)], key=str)
    assert token_counts.token_counts(odd.limit(0), pieces).count() == 0


TOY = Pieces(["a", "b", "ab", "ba", "aba", " a"], [-1.0, -1.2, -1.5, -1.1, -2.0, -0.7], -5.0)


def segmentations(text):
    if not text:
        yield (), 0.0
        return
    for k, t in enumerate(TOY.texts):
        if text.startswith(t):
            for rest, w in segmentations(text[len(t) :]):
                yield (k + 256, *rest), w + TOY.weights[k]
    if text[0] not in TOY.texts:  # a character without a piece is spelled in bytes
        for rest, w in segmentations(text[1:]):
            yield (*text[0].encode(), *rest), w + TOY.byte_weight * len(text[0].encode())


@pytest.mark.parametrize("text", ["abab", "ab abab"])
def test_samples_without_replacement_follow_the_lattice(text):
    all_ = dict(segmentations(text))
    total = sum(math.exp(w) for w in all_.values())
    p = {s: math.exp(w) / total for s, w in all_.items()}
    n = 6000
    pairs = Counter()
    for found in sample_texts([text] * n, list(range(n)), TOY, 2):
        pairs[tuple(found[0][0].tolist()), tuple(found[1][0].tolist())] += 1
        for ids, log_p, score in found:
            assert abs(log_p - math.log(p[tuple(ids.tolist())])) < 1e-9 and score <= 0
    for a, b in itertools.permutations(p, 2):
        assert abs(pairs[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.03
    assert not any(a == b for a, b in pairs)


def test_all_segmentations_of_a_short_text():
    (found,) = sample_texts(["abab"], [7], TOY, 50)
    assert {tuple(f[0].tolist()) for f in found} == set(dict(segmentations("abab"))) and all(s == 0 for *_, s in found)


def test_encode_round_trip(spark, tiny):
    pieces = Pieces.from_model(PIECES)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "  two  blanks\n\n▁literal \t日本語 \U0001f600"), (-1, None), (-2, ""), (-3, "a" * 3000), (-3, "a" * 3000)], "doc_id long, text string")
    both = docs.union(extra).withColumn("n_tokens", docs["doc_id"])
    rows = encode_samples(both, pieces, k=2).collect()
    texts = {(r["doc_id"], r["text"]) for r in both.collect()}
    for r in rows:
        assert r["round_trip"] and len({tuple(i) for i in r["token_ids"]}) == len(r["token_ids"])
        spelled = {pieces.decode(i) for i in r["token_ids"]}
        assert len(spelled) == 1 and ((r["doc_id"], *spelled) in texts or (r["doc_id"], None) in texts)
    again = {(r["doc_id"], tuple(r["tokens_hash"])) for r in encode_samples(both.repartition(7), pieces, k=2, ids=False).collect()}
    assert again == {(r["doc_id"], tuple(r["tokens_hash"])) for r in rows}
    assert encode_samples(both.limit(0), pieces).count() == 0


def brute_tiles(item, doc, least):
    fi, fd, out = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and fi[i + n] and fd[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return out
        fi[i : i + n], fd[d : d + n] = [False] * n, [False] * n
        out += n


def test_tiling_equals_brute_force():
    r = random.Random(4)
    for _ in range(150):
        item = np.array([r.randint(0, 3) for _ in range(r.randint(1, 30))], np.uint64)
        doc = np.array([r.randint(0, 3) for _ in range(r.randint(0, 60))], np.uint64)
        least = r.randint(2, 5)
        found = D.tiles(item, doc, least)
        assert sum(t[0] for t in found) == brute_tiles(item.tolist(), doc.tolist(), least)
        assert len({k for n, i, _ in found for k in range(i, i + n)}) == len({k for n, _, d in found for k in range(d, d + n)}) == sum(t[0] for t in found)


def test_decontamination(spark, tiny, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)  # several passes
    words = [f"item{k}" for k in range(40)]
    item = " ".join(words)
    moved = " ".join(["filler"] * 5 + words[20:] + ["gap"] * 9 + words[:20])
    docs = [(1, "Before, " + item.upper() + "! after"), (2, moved), (3, " ".join(words[:20])), (4, None), (5, ""), (None, item), (6, " ".join(f"other{k}" for k in range(300))), (6, "tiny thing here")]
    df = spark.createDataFrame([(*d, True) for d in docs], "doc_id long, text string, contaminated boolean")
    bench = spark.createDataFrame([(7, item), (8, " ".join(f"z{k}" for k in range(30))), (9, "tiny thing"), (None, item), (10, None), (11, "")] + [(100 + k, " ".join(f"q{k}x{j}" for j in range(50))) for k in range(40)], "item_id long, text string")
    out = D.mark_contaminated(df, bench).collect()
    assert [(r["doc_id"], r["item_ids"], r["contaminated"]) for r in out if r["doc_id"] not in (3, 6)] == [(1, [7], True), (2, [7], True), (4, [], False), (5, [], False), (None, [7], True)]
    assert sorted((r["item_ids"] for r in out if r["doc_id"] in (3, 6)), key=len) == [[], [], [9]]
    assert D.mark_contaminated(df.limit(0), bench).count() == 0 and D.mark_contaminated(df, bench.limit(0)).where("contaminated").count() == 0
    real = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{tiny}/benchmark.parquet")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    for r in D.mark_contaminated(real, items).collect():
        assert {i for i, t in texts.items() if t in r["text"]} <= set(r["item_ids"])


def test_lookup_table():
    names, slots = ("a", "b", "c", "d", "e"), 101
    table = sharding.fill_table(names, slots)
    orders = [[(sharding._number(f"offset:{s}") % slots + k * (sharding._number(f"skip:{s}") % (slots - 1) + 1)) % slots for k in range(slots)] for s in names]
    want, turn = {}, 0
    while len(want) < slots:
        k = turn % len(names)
        want[next(s for s in orders[k] if s not in want)] = k
        turn += 1
    assert table == [want[s] for s in range(slots)]
    big, less = sharding.fill_table(sharding.SHARDS), sharding.fill_table(sharding.SHARDS[:-1])
    assert max(Counter(big).values()) - min(Counter(big).values()) <= 1
    moved = sum(a != b for a, b in zip(big, less) if a != len(sharding.SHARDS) - 1)
    assert moved / len(big) < 0.1
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError, match="shards"):
            sharding.fill_table(bad)
    with pytest.raises(ValueError, match="prime"):
        sharding.fill_table(names, 100)


def test_assign_shards(spark, tiny, tmp_path):
    import hashlib

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "source").withColumn("slot", F_lit())
    table = sharding.fill_table(sharding.SHARDS)
    rows = sharding.assign_shards(docs, "doc_id").collect()
    assert len(rows) == 200
    for r in rows:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[table[slot]])
    odd = spark.createDataFrame([(None, 1), (None, 2), (4, 3)], "doc_id long, shard int")
    assert sharding.assign_shards(odd).count() == 3 and sharding.assign_shards(odd.limit(0)).count() == 0
    sharding.write_shards(docs.select("doc_id", "source"), str(tmp_path / "out"), parts=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
