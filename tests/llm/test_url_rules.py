"""URL rules in large numbers."""

from quarry.llm import urls


def test_no_rule_is_cut(spark):
    """Ten blocked hosts with frequent tokens make more than 500 rules of up to three tokens, all but the hosts' own without need; one rule of three tokens has less support."""
    query = "&".join(f"a{k}=1" for k in range(7))
    rows = [(f"https://bad{h}.com/x?{query}", True) for h in range(10) for _ in range(6)] + [(f"https://good.net/x?{query}", False)] * 60
    rows += [("https://mixed.org/buy?z=1", True)] * 3 + [(u, False) for u in ("https://mixed.org/buy", "https://mixed.org/y?z=1", "https://other.org/buy?z=1") for _ in range(20)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    rules = urls.mine_block_rules(labelled)
    tokens = {r["url"]: set(r["t"]) for r in labelled.distinct().select("url", urls.tokens_of(labelled["url"]).alias("t")).collect()}
    assert any(set(r) <= tokens["https://mixed.org/buy?z=1"] for r in rules)
    assert not any(set(a) < set(b) for a in rules for b in rules)
    out = {r["url"]: r["hit"] for r in labelled.distinct().select("url", urls.matches(urls.tokens_of(labelled["url"]), rules).alias("hit")).collect()}
    assert out == {u: b for u, b in rows}


def test_many_rules_match(spark):
    rules = [sorted([f"h1=x{k}", 'p="q\\é']) for k in range(5000)]
    rows = spark.createDataFrame([(["h1=x4999", 'p="q\\é'],), (["h1=x5000", 'p="q\\é'],), (["h1=x1"],), (None,)], "t array<string>")
    assert [bool(r[0]) for r in rows.select(urls.matches(rows["t"], rules)).collect()] == [True, False, False, False]


def test_most_urls_blocked(spark):
    rows = [("https://bad.com/x", True)] * 60 + [("https://good.net/x", False)] * 40
    rules = urls.mine_block_rules(spark.createDataFrame(rows, "url string, block boolean"))
    assert ["h1=bad"] in rules and not any("h1=good" in r or r == ["p=x"] for r in rules)
    assert urls.mine_block_rules(spark.createDataFrame(rows[:60], "url string, block boolean")) == []
