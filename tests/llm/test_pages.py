"""HTML extraction and URL filters."""

import html
import itertools
import re

import numpy as np
import pytest

from quarry.llm import urls
from quarry.llm.block_labeller import Labeller, features, trained, training_page
from quarry.llm.html_blocks import blocks_of
from quarry.llm.html_extract import extract_main_text, main_texts


def test_gradient():
    r = np.random.default_rng(1)
    made = [training_page(r) for _ in range(3)]
    pages, labels = [features(b) for b, _ in made], [y for _, y in made]
    model = Labeller(3)
    model.p["tokens"] += r.normal(0, 0.1, model.p["tokens"].shape)
    _, g = model.gradient(pages, labels)
    for name, grad in g.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = model.gradient(pages, labels)[0]
        model.p[name][at] = old - 1e-5
        down = model.gradient(pages, labels)[0]
        model.p[name][at] = old
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-4 * max(1, abs(grad[at])), name


def test_held_out_accuracy():
    r = np.random.default_rng(77)
    made = [training_page(r) for _ in range(80)]
    scores = trained().scores([features(b) for b, _ in made])
    right = np.concatenate([(s > 0) == (y > 0) for s, (_, y) in zip(scores, made)])
    assert right.mean() > 0.985


def expected(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


def test_supplied_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = {r["page_id"]: expected(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_main_text(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_other_page_shapes():
    body = "".join(f"<p>Paragraph {k} tells a long story about the river, the mill and its people.</p>" for k in range(5))
    page = f"""<html><head><title>no</title></head><body><header><a href=/>Logo</a></header><div class="cookie-notice"><p>We use cookies.</p></div>
      <nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><main><h1>The  mill &amp; the&nbsp;river</h1>{body}</main>
      <aside class="sidebar"><h3>Popular</h3><ul><li><a href=c>More</a></li></ul></aside><section class="comments"><div class="comment"><p>First! Great read.</p></div></section>
      <form class="newsletter"><label>Mail</label></form><footer>&copy; Imprint</footer><script>var a = "<p>x</p>";</script></body></html>"""
    (text,) = main_texts([page], trained())
    assert text == "\n".join(["The mill & the river", *(f"Paragraph {k} tells a long story about the river, the mill and its people." for k in range(5))])


def test_blocks():
    got = blocks_of("<div>a <b>b</b>\n c<br>d<p>e<p>f<!-- x --><ul><li>g<li>h</ul><script>no</script>&lt;i&gt; <a href='>'>k</a> tail")
    assert [b.text for b in got] == ["a b c d", "e", "f", "g", "h", "<i> k tail"]
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> </p>") == []
    assert [b.text for b in blocks_of("plain < text")] == ["plain < text"]


def test_extract_edge_cases(spark):
    rows = [(1, None, None, "x"), (1, "u", "", "y"), (None, "u", "<article><p>One two three four five six seven.</p></article>", "z"), (2, "u", "<p>" * 3000, "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] is None, r["url"], r["n_chars"]) for r in out.collect() if r["url"]) == [(False, "u", 0), (False, "u", 0), (True, "u", 34)]
    assert extract_main_text(df.limit(0)).count() == 0


CASES = [
    ("http://a.com/x", "a.com", "/x", "com/", "allow"),
    ("http://Sub.EXAMPLE.com/en/1?q#f", "sub.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://m.www.example.com/en/x", "m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
    ("https://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("https://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("https://x.net/ES/1", "x.net", "/ES/1", None, "allow"),
    ("https://x.com", "x.com", "", None, "allow"),
    ("https://x.com?u=/en/", "x.com", "", None, "allow"),
    ("http://a.org://b.com/x", "a.org:", "//b.com/x", None, "allow"),
    ("no scheme com/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_fixed_rules(spark):
    df = spark.createDataFrame([(k, c[0], "h") for k, c in enumerate(CASES)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, labels).collect()}
    assert out == {k: c[1:] for k, c in enumerate(CASES)}
    assert urls.judge_urls(df.limit(0), labels).count() == 0


def test_mined_rules_equal_brute_force(spark):
    pages, labels = [], []
    for k in range(400):
        bad = k % 9 == 0
        host = "spam.example.org" if bad else ("good.example.org" if k % 2 else "spam.other.org")
        pages.append((k, f"https://{host}/{'buy' if bad or k % 5 == 0 else 'read'}/{k}"))
        labels.append((k, 0 if bad else 1))
    pages += [(None, "https://spam.example.org/buy/1"), (9000, "https://spam.example.org/buy/77"), (9001, "https://good.example.org/buy/77")]
    labels += [(None, 0), (1, None)]
    df, lb = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    tokens = {r["page_id"]: set(r["t"]) for r in df.where("page_id < 400").select("page_id", urls.tokens_of(df["url"]).alias("t")).collect()}
    block = {k for k, q in labels if q == 0 and k is not None}
    base = len(block) / 400
    rules = []
    for size in range(1, 4):
        for combo in itertools.combinations(sorted(set().union(*tokens.values())), size):
            own = [k for k, t in tokens.items() if set(combo) <= t]
            if own and len(block & set(own)) / 400 >= urls.SUPPORT and len(block & set(own)) / len(own) >= max(urls.CONFIDENCE, urls.LIFT * base) and not any(set(r) <= set(combo) for r in rules):
                rules.append(combo)
    got = {(r["page_id"], r["url"]): r["verdict"] for r in urls.judge_urls(df, lb).select("page_id", "verdict").join(df, "page_id").collect()}
    for k, url in pages:
        if k is not None and k < 400:
            assert got[k, url] == ("block" if any(set(r) <= tokens[k] for r in rules) else "allow")
    assert got[9000, pages[-2][1]] == "block" and got[9001, pages[-1][1]] == "allow"


def test_too_many_fixed_rules():
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="1000"):
        urls.fixed_rule(F.lit("h"), F.lit("p"), urls.RULES * 300)
