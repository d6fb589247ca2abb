"""URL filters: fixed rules by host and path, and association rules that FP-growth mines from labelled URLs. Built-in functions only."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.durable import as_id, durable

#: Least share of labelled URLs that hold a combination, least share of them that are labelled block, and the ratio to the overall share that is exceeded.
SUPPORT, CONFIDENCE, LIFT = 0.01, 0.6, 1.0
#: Blocked rows that a combination needs at least, so that a small table makes no rules of single sites.
LEAST_ROWS = 3
MOST_FIXED = 1000
_BLOCK = "label=block"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased. Null or no ://: empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: host labels by their place from the right, host, path segments, file ending, query names, scheme, fragment."""
    text = F.coalesce(url, F.lit(""))
    labels = F.reverse(F.split(host_of(text), r"\."))
    parts = [
        F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x)),
        F.array(F.concat(F.lit("host="), host_of(text))),
        F.transform(F.split(path_of(text), "/"), lambda x: F.concat(F.lit("p="), F.regexp_replace(x, r"[0-9]+", "0"))),
        F.array(F.concat(F.lit("end="), F.regexp_extract(path_of(text), r"\.([A-Za-z0-9]+)$", 1))),
        F.transform(F.split(F.regexp_extract(text, r"\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("q="), F.regexp_extract(x, r"^([^=]*)", 1))),
        F.array(F.concat(F.lit("s="), F.regexp_extract(text, r"^([A-Za-z]+)://", 1))),
        F.array(F.when(F.contains(text, F.lit("#")), F.lit("f=yes")).otherwise(F.lit("f="))),
    ]
    return F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda x: ~F.endswith(x, F.lit("=")) & (x != "host=")))


def fixed_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null where none does."""
    if len(rules) > MOST_FIXED:
        raise ValueError(f"at most {MOST_FIXED} fixed rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # a later one overrides
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def mine_block_rules(labelled: DataFrame, url_col: str = "url", block_col: str = "block", support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least: int = LEAST_ROWS) -> list[list[str]]:
    """Token combinations that stand for block in rows (url, block boolean), without those that contain another.

    A combination is held by a share `support` of all rows and by `least` rows, blocked ones only. Tokens of exactly the same rows are mined
    as one, so that tokens which always come together make no combinations of their own; the rules name each of them again.
    """
    bag = labelled.where(F.col(block_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), tokens_of(F.col(url_col)).alias("t"), F.col(block_col).alias("b"))
    bag = durable(bag, "labelled_urls")
    n, blocked = bag.agg(F.count("*"), F.count_if("b")).first()
    if not blocked:
        return []
    least = max(least, math.ceil(support * n - 1e-9))
    each = bag.select("row", "b", F.explode("t").alias("token"))
    alike = each.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("two")).where(F.col("c") >= least)
    # frequent tokens are at most the mean number of tokens over the support
    groups = durable(alike.groupBy("c", "one", "two").agg(F.sort_array(F.collect_list("token")).alias("same")).select(F.col("same")[0].alias("name"), "same"), "alike_tokens")
    names = groups.select("name", F.explode("same").alias("token"))
    items = durable(each.join(F.broadcast(names), "token").groupBy("row", "b").agg(F.collect_set("name").alias("t")).select(F.when(F.col("b"), F.array_append("t", F.lit(_BLOCK))).otherwise(F.col("t")).alias("items")), "url_items")
    m = items.count()
    if m < least:
        return []
    rules = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / m, minConfidence=confidence).fit(items).associationRules
    found = rules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _BLOCK) & (F.col("confidence") * n > lift * blocked * (1 + 1e-12)))
    kept = smallest(r["a"] for r in found.select(F.array_sort("antecedent").alias("a")).orderBy(F.size("a"), "a").toLocalIterator())
    same = {r["name"]: r["same"] for r in groups.collect()}
    return [sorted(r) for k in kept for r in itertools.product(*(same[t] for t in k))]


def smallest(rules: Iterable[list[str]]) -> list[list[str]]:
    """The rules, given by size, that contain no other one. Only these are held; a rule meets those that begin with a token of its own."""
    kept: list[list[str]] = []
    by_first: dict[str, list[frozenset[str]]] = {}
    for r in rules:
        own = frozenset(r)
        if not any(k <= own for t in r for k in by_first.get(t, ())):
            kept.append(list(r))
            by_first.setdefault(r[0], []).append(own)
    return kept


def matches(tokens: Column, rules: list[list[str]]) -> Column:
    """Whether all tokens of some rule occur: an inverted index from each rule's first token leads to the few rules to be checked."""
    if not rules:
        return F.lit(False)
    index: dict[str, list[list[str]]] = {}
    for r in rules:
        index.setdefault(r[0], []).append(r)
    table = F.from_json(F.lit(json.dumps(index)), "map<string,array<array<string>>>")  # one literal, for any number of rules
    return F.exists(tokens, lambda t: F.exists(F.coalesce(F.try_element_at(table, t), F.array().cast("array<array<string>>")), lambda r: F.size(F.array_except(r, tokens)) == 0))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """id_col, host, path, rule and verdict of every row of pages.

    The longest fixed rule decides. Without one, a URL is blocked if a mined rule matches, else allowed. Mining uses the rows of labels
    whose id is that of a page; label 0 means block. Null urls have empty host and path and are allowed. Rows that repeat an id are judged one by one.
    """
    known = labels.select(as_id(label_id).alias("id"), (F.col(label_col) == 0).alias("block")).where("id is not null and block is not null")
    urls = pages.select(as_id(id_col).alias("id"), F.col(url_col).alias("url"))
    mined = mine_block_rules(urls.join(known, "id").select("url", "block"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rest = urls.select("id", "url", host.alias("host"), path.alias("path"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    other = F.when(matches(tokens_of(F.col("url")), mined), F.lit("block")).otherwise(F.lit("allow"))
    return rest.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, other).alias("verdict"))
