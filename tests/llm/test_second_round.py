"""Wide ranges of vectors, clashing columns, decoding, long texts, running hashes, rules by brute force, and stable URL rules."""

import re

import numpy as np
import pytest

from quarry.llm import decontaminate, near_dedup, quality, sharding, urls
from quarry.llm.embedding_dedup import embedding_duplicates
from quarry.llm.lattice import Pieces, decode_samples, encode_samples
from quarry.llm.near_dedup import near_duplicates
from quarry.llm.suffix_dedup import remove_repeats


def test_doubles_of_any_size_link(spark):
    rows = [(1, "x", [1e40, 0.0]), (2, "x", [2e40, 0.0]), (3, "x", [1e-60, 0.0]), (4, "x", [1.0, 0.0]), (5, "y", [1.0, 0.0]), (6, "x", [1e300, 1e300]), (7, None, [1.0, 0.0])]
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert out == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (3, 1, False), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True)}


def test_labels_are_compared_as_they_are(spark):
    rows = [(1, 1.2, [1.0, 0.0]), (2, 1.7, [1.0, 0.0]), (3, 1.2, [1.0, 0.0]), (4, 0.0, [0.0, 1.0]), (5, -0.0, [0.0, 1.0])]
    out = {r["vec_id"]: r["component_id"] for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, label double, embedding array<float>")).collect()}
    assert out == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_columns_that_clash_stay(spark):
    docs = spark.createDataFrame([(1, "one two", "kept", 7), (2, None, "too", 8)], "doc_id long, text string, __chars string, __words int")
    out = quality.score_quality(docs, quality.RuleEnsemble(0.0, ())).orderBy("doc_id").collect()
    assert [(r["__chars"], r["__words"], r["score"]) for r in out] == [("kept", 7, 0.5), ("too", 8, 0.5)]
    shards = sharding.assign_shards(spark.createDataFrame([(1, "a")], "doc_id long, __slot string")).first()
    assert shards["__slot"] == "a" and shards["slot"] >= 0


def test_samples_decode(spark):
    pieces = Pieces(["a", "b", "ab", " a", "é"], [-1.0, -1.0, -1.5, -2.0, -3.0], -8.0)
    texts = [(1, "ab ab"), (2, ""), (3, None), (4, "é€\U0001f600 x\n\n y"), (5, "ab" * 2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = decode_samples(encode_samples(docs, pieces, k=2), pieces)
    assert "token_ids" in out.columns
    for r in out.collect():
        assert set(r["texts"]) == {dict(texts)[r["doc_id"]] or ""} and r["round_trip"]
    assert decode_samples(out.limit(0), pieces).count() == 0
    assert decode_samples(spark.createDataFrame([(None, "k"), ([[]], "l")], "token_ids array<array<int>>, texts string"), pieces, out_col="texts").orderBy("texts").collect() == [(None, None), ([[]], [""])]


@pytest.mark.parametrize("n", [1, 3, 5, 20])
def test_running_hashes(n):
    h = np.array([5, 7, 5, 7, 5, 9, 5, 7, 5], np.uint64)
    grams = decontaminate._grams(h, n)
    runs = [tuple(h[k : k + n]) for k in range(max(0, len(h) - n + 1))]
    assert len(grams) == len(runs) and all((grams[a] == grams[b]) == (runs[a] == runs[b]) for a in range(len(runs)) for b in range(len(runs)))


def test_texts_over_the_buffer(spark):
    r = np.random.default_rng(4)
    long = " ".join(f"w{k}" for k in r.integers(0, 10**6, 250_000))  # about 1.9 MB
    near = long.replace(" w1", " q1", 200)
    docs = spark.createDataFrame([(1, long), (2, near), (3, long[:5000]), (4, "short text of its own")], "doc_id long, text string")
    out = {x["doc_id"]: (x["component_id"], x["n_shingles"]) for x in near_duplicates(docs).collect()}
    assert out[1][0] == out[2][0] == 1 and out[3][0] == 3 and out[4][0] == 4
    words = long.split(" ")
    assert out[1][1] == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    cut = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"]) for x in remove_repeats(docs, texts=False).collect()}
    assert cut[1][1] == 0 and cut[3] == (5000, 5000, 1) and cut[4][1] == 0 and 0.9 < cut[2][1] / cut[2][0] < 1


def test_scores_equal_brute_force(spark):
    texts = ["", "Plain words, and more. Numbers 12 3.", "a a a A | | {{}} [[x]] !!!! 99\nLine\n\nÄÖ ß", "word " * 50, None, "\t \n", "end. end? end! x.y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, quality int")
    random = np.random.default_rng(5)
    count = lambda p, t: len(re.findall(p, t))

    def stats(t):
        t = t or ""
        words, chars = count(r"\S+", t), len(t)
        per = {"repeated": r"(?<!\S)(\S+)(?=\s+\1(?!\S))", "bars": r"(?<!\S)\|(?!\S)", "symbols": r"[#&%$*<>=_~^{}\[\]\\]{2,}", "shouts": r"!{2,}", "ends": r"[.!?](?!\S)", "numbers": r"(?<!\S)[0-9]+"}
        out = {"chars": chars, "words": words, "word_length": chars / max(words, 1)}
        out |= {k: len(list(re.finditer(p, t))) / max(words, 1) for k, p in per.items()}
        return out | {"upper": sum(c.isupper() for c in t) / max(chars, 1), "digits": count(r"[0-9]", t) / max(chars, 1), "lines": t.count("\n") / max(chars, 1)}

    names = list(stats(""))
    rules = tuple(quality.Rule(tuple((names[random.integers(len(names))], bool(random.integers(2)), float(random.choice([0, 0.05, 0.2, 1, 5, 20]))) for _ in range(random.integers(1, 4))), float(random.normal())) for _ in range(60))
    model = quality.RuleEnsemble(0.3, rules)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    for k, t in enumerate(texts):
        s = stats(t)
        total = 0.3 + sum(r.weight for r in rules if all((s[n] > b) if up else (s[n] <= b) for n, up, b in r.conditions))
        assert np.isclose(got[k]["score"], 1 / (1 + np.exp(-total))) and got[k]["predicted"] == int(got[k]["score"] >= 0.7)
    fitted = quality.fit_quality(docs, labels)
    assert 0 <= quality.score_quality(docs, fitted).agg({"score": "max"}).first()[0] <= 1


def test_few_labels_make_no_rules_of_single_sites(spark):
    rows = [(f"https://site{k}.com/a/{k}", k % 7 == 0) for k in range(60)]
    assert urls.mine_block_rules(spark.createDataFrame(rows, "url string, block boolean")) == []
    assert urls.mine_block_rules(spark.createDataFrame([], "url string, block boolean")) == []
    often = rows + [("https://bad.org/b", True)] * 3
    assert ["host=bad.org"] in urls.mine_block_rules(spark.createDataFrame(often, "url string, block boolean"))


def test_tokens_that_always_come_together(spark):
    """Forty tokens of the same rows are mined as one; each of them is a rule."""
    tail = "/".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    rows = [(f"https://bad.org/{tail}", True)] * 30 + [("https://good.org/x", False)] * 70
    rules = urls.mine_block_rules(spark.createDataFrame(rows, "url string, block boolean"))
    assert all(len(r) == 1 for r in rules) and {r[0] for r in rules} >= {"h1=bad", "host=bad.org", "p=aa", "p=nb"}


def test_buckets_take_bits_that_differ():
    """Sketches hold small hashes: their low bits still spread."""
    values = np.sort(near_dedup.U64(1) * np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64))[:3000].view(np.int64)
    assert len(np.unique(values & ((1 << near_dedup.BITS) - 1))) > 2900


def _greedy(item, doc, least):
    """Greedy string tiling by trying all places."""
    free_i, free_d, out = [1] * len(item), [1] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                best = max(best, (n, i, d), key=lambda m: m[0])
        if best[0] < least:
            return out
        for k in range(best[0]):
            free_i[best[1] + k] = free_d[best[2] + k] = 0
        out.append(best)


def test_tiles_of_few_words_equal_brute_force():
    r = np.random.default_rng(3)
    for _ in range(150):
        words, least = r.choice([2, 3, 6]), int(r.choice([1, 2, 3, 5]))
        item, doc = (r.integers(1, words + 1, r.integers(1, n)).astype(np.uint64) for n in (40, 60))
        assert decontaminate.tiles(item, doc, least) == _greedy(item.tolist(), doc.tolist(), least)
    repeated = np.full(20_000, 7, np.uint64)
    assert decontaminate.tiles(repeated[:500], repeated) == [(500, 0, 0)]


def test_blocks_of_a_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    monkeypatch.setattr(decontaminate, "HELD_BLOCKS", 2)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(8))) for k in range(12)]
    docs = [(k, f"some words before {t} and after") for k, t in items[::2]] + [(99, "clean words of its own here"), (100, None)]
    out = decontaminate.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["item_ids"] for r in out.collect()} == {k: ([k] if k < 50 else []) for k, _ in docs}
