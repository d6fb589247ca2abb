"""The contains-join against plain search in strings."""

import random

from quarry.operators import contains


def plain(texts, needles):
    return sorted((t, n, k, k + len(s)) for t, x in texts for n, s in needles for k in range(len(x or "") - len(s) + 1) if x[k : k + len(s)] == s)


def test_a_needle_shares_all_its_seeds():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("abé ") for _ in range(60))
        start = r.randint(0, 48)
        needle = text[start : start + r.randint(12, 60 - start)]
        own = set(zip(*(x.tolist() for x in contains.minimizers(text))))
        inside = list(zip(*(x.tolist() for x in contains.minimizers(needle))))
        assert inside and all((h, at + start) in own for h, at in inside)
    assert len(contains.minimizers("short text")[0]) == 0


def test_equals_plain_search(spark):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("ab c") for _ in range(n))
    texts = [(k, text(r.randint(0, 90))) for k in range(150)] + [(900, None), (901, ""), (902, "a" * 40), (903, "a" * 40), (904, "日本語の長い文章がここにありますよね")]
    cut = lambda s: s[r.randint(0, 20) :][: r.randint(12, 30)]
    needles = list(enumerate(sorted({c for _, t in texts[:80] if len(c := cut(t)) >= 12} | {"a" * 12, "a" * 20, "nowhere to be seen", "語の長い文章がここにあります"})))
    found = contains.occurrences(spark.createDataFrame(texts, "text_id long, text string").repartition(3), spark.createDataFrame(needles, "needle_id long, needle string"))
    got = sorted((x["text_id"], x["needle_id"], x["start"], x["end"]) for x in found.collect())
    assert got == plain(texts, needles) and len(got) > 80
    inner = {(x["text_id"], x["needle_id"], x["start"]) for x in contains.outermost(found).where("inner").collect()}
    want = {(t, n, a) for t, n, a, e in got if any(t == u and m != n and b <= a and e <= f for u, m, b, f in got)}
    assert inner == want and inner


def test_empty_tables(spark):
    texts, needles = spark.createDataFrame([], "text_id long, text string"), spark.createDataFrame([], "needle_id long, needle string")
    assert contains.occurrences(texts, needles).count() == 0
    assert contains.occurrences(spark.createDataFrame([(1, "a text of some length")], "text_id long, text string"), needles).count() == 0
