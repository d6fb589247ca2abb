import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import query_compiler as Q
from quarry.functions import text as T
from quarry.functions.globs import glob_regex, ignore_regex
from quarry.functions.spans import match_spans
from quarry.model import Filters, Fusion, GraphOptions, Mmr, Parent, SearchOptions, checked_query


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("再ランキングの評価について", ["再ランキング", "ランキング", "の評価", "について"]),
        ('"Foundry Local" の設定', ["Foundry Local", "の設定"]),
        ("AI について", ["について"]),
        ("vector search", ["vector", "search"]),
        ('say ""hi"" now', ["say", "now"]),
        ('"a ""b"" c"', ['a "b" c']),
        ('open "quote here', ["open", "quote", "here"]),
        ("snake_case-word", ["snake_case-word"]),
        ("same same", ["same"]),
        ("", []),
    ],
)
def test_phrases(query, want):
    assert Q.phrases(query) == want


def test_fallback_and_cap():
    assert Q.compile_query("AI と ML") == ["AI と ML"] and Q.compile_query("ab") == [] and Q.compile_query("a\0 b") == []
    assert len(Q.compile_query(" ".join(f"word{k}" for k in range(50)))) == 32
    assert Q.match_expression(['a"b', "c"]) == '"a""b" OR "c"'


def test_phrases_are_parts_of_the_query():
    r = random.Random(1)
    for _ in range(300):
        q = "".join(r.choice('ab 漢字かなカナ"_-.') for _ in range(r.randint(0, 20)))
        assert all(p in q.replace('""', '"') or p in q for p in Q.phrases(q))


def test_spans():
    assert match_spans("alpha beta", "Alpha beta ALPHA") == [(0, 5), (6, 10), (11, 16)]
    assert match_spans("tion", "nationtion") == [(2, 6), (6, 10)]
    assert match_spans("日本語", "日本語") is None and match_spans("abc", "x" * (256 * 1024 + 1)) is None
    assert match_spans("abc", "é abc") == [(3, 6)] and match_spans("abc", "none") == []
    assert len(match_spans("aaa", "aaa " * 500)) == 100


def test_columns(spark):
    rows = [("Crème Brûlée\tx", "a/b/c.md"), (" TBD. ", "my-file_name.txt"), ("x" * 250, "a/f.MD")]
    df = spark.createDataFrame(rows, "t string, p string")
    got = df.select(T.fold(F.col("t")).alias("f"), T.is_boilerplate(F.col("t")).alias("b"), T.snippet(F.col("t")).alias("s"), T.category_of(F.col("p")).alias("c"), T.topic_of(F.col("p")).alias("o"), T.title_from_path(F.col("p")).alias("n"), T.group_prefix(F.col("p")).alias("g"), T.extension_of(F.col("p")).alias("e")).collect()
    assert [r["f"] for r in got][0] == "creme brulee\tx" == T.fold_text(rows[0][0])
    assert [r["b"] for r in got] == [False, True, False] and len(got[2]["s"]) == 201
    assert [(r["c"], r["o"], r["n"], r["g"], r["e"]) for r in got] == [("a", "b", "c", "a/b", "md"), (None, None, "my file name", "", "txt"), ("a", None, "f", "a", "md")]


def test_quality(spark):
    texts = ["short", "TODO", "x" * 50, "x" * 90, "a line\nand another line that is longer than thirty", "(準備中)"]
    got = [r["q"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.quality_score(F.col("t")).alias("q")).collect()]
    assert got == [0.1, 0.0, 0.7, 1.0, 1.0, 0.0]
    assert all(0 <= q <= 1 for q in got)


def test_more_columns(spark):
    df = spark.createDataFrame([(["Doc", " Doc ", "", None, "Part"],), ([None],)], "p array<string>")
    assert [r[0] for r in df.select(T.breadcrumb(F.col("p"))).collect()] == ["Doc > Part", None]
    d = spark.createDataFrame([("D:20240131120000",), ("2024-02-01T00:00",), ("soon",)], "d string")
    assert [r[0] for r in d.select(T.iso_date(F.col("d"))).collect()] == ["2024-01-31", "2024-02-01", None]
    x = spark.createDataFrame([("inter-\nnal ﬁle",)], "x string").select(T.expand_ligatures(T.dehyphenate(F.col("x")))).first()[0]
    assert x == "internal file"
    tags = spark.createDataFrame([('["a"]',), ("oops",), (None,)], "t string").select(T.parse_tags(F.col("t"))).collect()
    assert [r[0] for r in tags] == [["a"], [], []]
    h = spark.createDataFrame([(" ## A b",), ("### C",), ("# no",)], "h string").select(T.heading_level(F.col("h")), T.heading_text(F.col("h"))).collect()
    assert [tuple(r) for r in h] == [(2, "A b"), (3, "C"), (None, None)]


def test_uris():
    assert T.parse_uri("kb://doc/" + T.encode_path("a b/ü.md")) == ("doc", "a b/ü.md") and T.parse_uri("kb://topic/x") == ("topic", "x")
    for bad in ("kb://doc/%2e%2e/x", "kb://doc/", "kb://doc/%zz", "kb://doc//x", "http://doc/x", "kb://doc/a%00", "kb://doc/%ff"):
        assert T.parse_uri(bad) is None
    assert T.section("# t\n## One\na\n## Two b\nc\nd\n## X", "two") == "## Two b\nc\nd" and T.section("x", "y") is None
    assert T.truncate_bytes("aé", 2) == "a"


@pytest.mark.parametrize(("glob", "path", "want"), [("*.md", "a/b.md", True), ("a/**/c", "a/c", True), ("a/**/c", "a/b/c", True), ("?.md", "ab.md", False), ("{a,b}.md", "b.md", True), ("[!a].md", "a.md", False)])
def test_globs(glob, path, want):
    import re

    assert bool(re.match(glob_regex(glob), path)) == want


def test_ignore():
    import re

    rule = lambda p, path: bool(re.match(ignore_regex(p)[0], path))
    assert rule("build/", "a/build/x.md") and rule("*.tmp", "d/x.tmp") and not rule("/top.md", "a/top.md") and ignore_regex("# c") is None and ignore_regex("!keep.md")[1]


def test_options():
    for make in (lambda: Mmr(lam=2), lambda: Fusion(k=0), lambda: Fusion(heading=0, context=0, content=0), lambda: Parent(whole_document_below=100, max_tokens=100), lambda: Filters(tags_any=("x",) * 65), lambda: GraphOptions(strategy="x"), lambda: checked_query("x" * 1025)):
        with pytest.raises(ValueError):
            make()
    assert Filters().any and not Filters(include_low_quality=True).any and Filters(min_quality=float("nan")).threshold == 0.3
    assert SearchOptions(limit=5000).hits == 1000 and SearchOptions(limit=3, rerank=True).pool == 250 and GraphOptions(depth=9).depth == 3
