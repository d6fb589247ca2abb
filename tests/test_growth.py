"""What searches hand on and make does not grow with batches, blocks or parts that nobody asks for."""

import numpy as np
import pyarrow as pa
import pytest

from quarry.model import Filters
from quarry.operators import retrieval, tuning
from quarry.plans import catalogue
from quarry.sources import index


def test_a_task_hands_on_each_query_once():
    r = np.random.default_rng(1)
    x, q = r.normal(size=(400, 8)), r.normal(size=(5, 8))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(low, low + 40)), pa.array(x[low : low + 40].tolist(), pa.list_(pa.float64()))], names=["chunk_id", "embedding"]) for low in range(0, 400, 40)]
    rows = [r for b in retrieval._nearest([3, 4, 5, 6, 7], q, 10)(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["query_id"] for r in rows) == [3, 4, 5, 6, 7]
    for r in rows:
        want = np.argsort(np.sqrt(((x - q[r["query_id"] - 3]) ** 2).sum(1)), kind="stable")[:10]
        assert np.frombuffer(r["chunks"], np.int64).tolist() == want.tolist()


def test_many_candidates_are_not_handed_on_again(monkeypatch):
    monkeypatch.setattr(retrieval, "KEPT", 10)
    best = retrieval._Best(np.ones(20), 10.0, [(q, [q, (q + 1) % 20]) for q in range(20)], [(0, 1.0, 1.0, 1.0), (1, 2.0, 0.5, 1.0)], 4)
    r = np.random.default_rng(2)
    out = []
    for g in range(6):
        found = np.unique(np.stack([r.integers(0, 50, 300), r.integers(0, 20, 300)], 1), axis=0)
        out += best.add(np.arange(50) + 50 * g, np.full(50, 10), np.concatenate([found, r.integers(1, 4, (len(found), 3))], 1))
    out += best.handed()
    assert len(out) == 20 * 2 and all(len(b.column(2)[0].as_py()) == 8 * 4 for b in out)


@pytest.mark.parametrize("k", [3, None])
def test_more_phrases_than_are_looked_up(spark, k, monkeypatch):
    words = ["river", "mill", "stone", "grain"]
    r = np.random.default_rng(5)
    chunks = spark.createDataFrame([(n, None, "x", " ".join(r.choice(words, 5))) for n in range(300)], "id long, heading string, context_text string, content string").repartition(3)
    queries = spark.createDataFrame([(n, " ".join(p)) for n, p in enumerate([["river"], ["mill", "stone"], ["stone", "mill"], ["grain", "river", "mill"]])], "query_id long, query string")
    weights = retrieval.weight_table(spark, (1.0, 1.0, 1.0))
    want = sorted(tuple(x) for x in retrieval.bm25(chunks, queries, weights, k).collect())
    monkeypatch.setattr(retrieval, "GROUP", 20)
    monkeypatch.setattr(retrieval, "STATE", 3)
    got = sorted(tuple(x) for x in retrieval.bm25(chunks, queries, weights, k).collect())
    assert got == want
    assert [x[2:] for x in got if x[0] == 1] == [x[2:] for x in got if x[0] == 2] and len(retrieval._asked_once([(1, ["a", "b"]), (2, ["b", "a"])])[1]) == 1


def test_only_what_is_asked_for_is_made(spark, tiny, monkeypatch):
    made = []
    monkeypatch.setattr(index, "_built", {})
    monkeypatch.setattr(index, "write_postings", lambda *a, **k: made.append("postings"))
    monkeypatch.setattr(index, "write_cells", lambda *a, **k: made.append("cells"))
    assert catalogue.queries()["group_paths"](spark, tiny).count() == 200
    kb = index.stored(spark, tiny)
    assert kb.text is not None and kb.cells is not None and "chunks" not in vars(kb) and not made


@pytest.mark.parametrize("k", [4, 40])
def test_orders_under_many_weights(spark, k, monkeypatch):
    words = ["river", "mill", "stone", "grain", "the"]
    r = np.random.default_rng(9)
    rows = [(n, "river" if n % 7 == 0 else None, "mill x" if n % 5 == 0 else "x", " ".join([*r.choice(words[:4], int(r.integers(1, 9))), "the" * (n % 9 > 0)])) for n in range(500)]
    chunks = spark.createDataFrame(rows, "id long, heading string, context_text string, content string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(["river", "mill stone", "stone mill", "grain river mill", "the", "the river", "none here", ""])), "query_id long, query string")
    triples = [(0.5, 4.0, 1.0), (1.0, 1.0, 1.0), (4.0, 0.5, 2.0)]
    want = sorted((x["query_id"], x["weight_id"], x["rank"], x["chunk_id"]) for x in retrieval.bm25(chunks, queries, retrieval.weight_table(spark, *triples), k).collect())
    monkeypatch.setattr(retrieval, "GROUP", 200)
    monkeypatch.setattr(retrieval, "POOLED", 2)
    got = []
    for x in retrieval.text_orders(chunks, queries, triples, k).collect():
        orders = np.frombuffer(x["orders"], np.int32).reshape(3, k)
        got += [(x["query_id"], w, n, x["chunks"][at]) for w, own in enumerate(orders) for n, at in enumerate(own) if at >= 0]
    assert sorted(got) == want and len(want) > 6 * 3 * k * 0.9


def test_sweep_metrics_equal_the_table_of_hits(spark, tiny):
    kb, asked, golden = index.stored(spark, tiny), catalogue.every_query(spark, tiny).where("query_id in (0, 50)"), catalogue._sweep_golden(spark, tiny).where("query_id in (0, 50)")
    hits = tuning.sweep(kb, asked, golden, Filters(), 10)
    got, want = (sorted((*x[:4], round(x[4], 9)) for x in t.collect()) for t in (tuning.sweep_metrics(kb, asked, golden, Filters(), 10, (1, 5, 10)), tuning.metric_table(kb, hits, golden, (1, 5, 10))))
    assert got == want and len(got) == 2 * 384 * 7


def test_only_seeds_of_needles_are_stored(spark, monkeypatch):
    from quarry.operators import contains

    kept = {}
    monkeypatch.setattr(contains, "durable", lambda df, name: kept.setdefault(name, df.localCheckpoint()))
    texts = spark.createDataFrame([(n, f"line {n} of a text that nobody quotes, {n * 7919} times") for n in range(200)] + [(200, "and here: a sentence to be found"), (201, ""), (202, "short")], "text_id long, text string")
    needles = spark.createDataFrame([(1, "a sentence to be found")], "needle_id long, needle string")
    assert [tuple(x) for x in contains.occurrences(texts, needles).collect()] == [(200, 1, 10, 32)]
    assert 0 < kept["seeds"].count() < 40
    rows = contains.seeds(texts, "text_id", "text").collect()
    by = {}
    for x in rows:
        by.setdefault(x["id"], set()).add((x["seed"], x["at"]))
    assert all(by.get(i, set()) == set(zip(*(c.tolist() for c in contains.minimizers(t)))) for i, t in texts.collect())


def test_texts_are_looked_through_once_before_a_sweep(spark, tiny, monkeypatch):
    monkeypatch.setattr(retrieval, "LOOKED_UP", 0)
    kb, asked = index.stored(spark, tiny), catalogue.every_query(spark, tiny)
    want = {x["query_id"]: x["matches"] for x in retrieval.match_counts(kb.chunks, asked, kb.text).collect()}
    monkeypatch.setattr(retrieval, "_matching", lambda *a: pytest.fail("a second pass over the texts"))
    got = {x["query_id"]: x["matches"] for x in tuning.preflight(kb, asked).collect()}
    assert {q: n for q, n in got.items() if n} == want and want


def test_found_terms_take_few_bytes():
    r = np.random.default_rng(3)
    found = np.unique(np.stack([r.integers(0, retrieval.SLICE, 40_000), r.integers(0, 5000, 40_000)], 1)[:, ::-1], axis=0)[:, ::-1]
    found = np.concatenate([found, np.zeros((len(found), 2), np.int64), r.integers(1, 3, (len(found), 1))], 1)
    blob = retrieval._packed(found)
    assert (retrieval._hits_in(blob) == found).all() and len(blob) < 7 * len(found)
    found[5, 3] = 300  # counts of any size
    assert (retrieval._hits_in(retrieval._packed(found)) == found).all() and len(retrieval._hits_in(retrieval._packed(found[:0]))) == 0
    words, texts = ["ab", "b c", "bcd"], [["ab b c", None, "", "xab"], [None, "", "b", "cdab"], ["a", "b", "cd", "bcdab c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), *map(pa.array, texts)], names=["chunk_id", "heading", "context", "content"])
    rows, length = retrieval._occurrences(batch, retrieval._machine(words), retrieval._sizes(words))
    assert sorted(rows.tolist()) == [[0, 0, 1, 0, 0], [0, 1, 1, 0, 0], [3, 0, 1, 1, 1], [3, 1, 0, 0, 1], [3, 2, 0, 0, 1]] and length.tolist() == [4, 0, 0, 8]


def test_tasks_hand_on_what_is_within_the_edge_of_all(spark, monkeypatch):
    words = ["river", "mill", "stone", "grain"]
    r = np.random.default_rng(6)
    chunks = spark.createDataFrame([(n, None, "x", " ".join(r.choice(words, int(r.integers(1, 30))))) for n in range(2000)], "id long, heading string, context_text string, content string").repartition(8)
    queries = spark.createDataFrame([(n, " ".join(p)) for n, p in enumerate([["river"], ["mill", "stone"], ["stone", "mill"], ["grain", "river", "mill"]])], "query_id long, query string")
    vectors = spark.createDataFrame([(n, r.integers(-3, 4, 4).astype(float).tolist()) for n in range(2000)], "chunk_id long, embedding array<double>").repartition(8)
    near = spark.createDataFrame([(n, r.integers(-3, 4, 4).astype(float).tolist()) for n in range(5)], "query_id long, vector array<double>")
    weights, handed = retrieval.weight_table(spark, (1.0, 1.0, 1.0), (4.0, 0.5, 0.5)), spark.sparkContext.accumulator(0)
    run = lambda k: [sorted((*x[:-2], round(x[-2], 12), x[-1]) for x in t.collect()) for t in (retrieval.bm25(chunks, queries, weights, k), retrieval.knn(vectors, near, k))]
    want = {k: run(k) for k in (64, 100, 1500)}
    monkeypatch.setattr(retrieval, "MARKED", 0)
    seen = []
    flat, edges = retrieval._flat, retrieval._edges
    monkeypatch.setattr(retrieval, "_edges", lambda *a: seen.append(edges(*a)) or seen[-1])

    def counted(*a):
        def go(batches):
            def each():
                for b in batches:
                    handed.add(sum(len(x) // 8 for x in b.column(2).to_pylist()))
                    yield b

            yield from flat(*a)(each())

        return go

    monkeypatch.setattr(retrieval, "_flat", counted)
    assert run(100) == want[100] and len(seen) == 2 and len(seen[0]) == 6 and len(seen[1]) == 5
    assert 100 * 11 <= handed.value < 100 * 11 * 2.5
    assert run(64) == want[64] and run(1500) == want[1500]


def test_texts_of_other_chunks_are_not_shuffled(spark, tiny, monkeypatch):
    from quarry.model import SearchOptions
    from quarry.plans import search

    kb, asked, options = index.stored(spark, tiny), catalogue.every_query(spark, tiny), SearchOptions(limit=10)
    monkeypatch.setattr(search, "FEW", 0)
    want = sorted(map(str, search.search(kb, asked, options).collect()))
    counted = []
    monkeypatch.setattr(search, "hinted", lambda df: df)
    monkeypatch.setattr(search, "picked", lambda *a: counted.append(retrieval.picked(*a)) or counted[-1])
    monkeypatch.setattr(retrieval, "MOST_IDS", 9)
    assert sorted(map(str, search.search(kb, asked, options).collect())) == want
    assert 0 < counted[0].count() <= len(want) < kb.chunks.count()


def test_heads_of_lists_are_scored_and_no_more():
    r = np.random.default_rng(11)
    chunks, terms, k = 20_000, 12, 10
    found = np.concatenate([np.stack([np.sort(r.choice(chunks, n, replace=False)), np.full(n, t)], 1) for t, n in enumerate(r.integers(3, 9000, terms))])
    found = np.concatenate([found, r.integers(0, 2, (len(found), 2)), r.integers(1, 6, (len(found), 1))], 1)
    length, idf = r.integers(20, 900, chunks), r.uniform(0.1, 6, terms)
    idf[3] = 1e-6
    uses = [(q, r.choice(terms, int(r.integers(1, 5)), replace=False).tolist()) for q in range(40)]
    best, seen = retrieval._Best(idf, 300.0, uses, [(0, 2.0, 1.0, 1.0)], k), []
    scored = retrieval._Lists.scored
    retrieval._Lists.scored = lambda self, *a: (seen.append(len(x[1])) or x for x in scored(self, *a))
    try:
        for low in (0, 5000):  # two groups
            own = found[(found[:, 0] >= low) & (found[:, 0] < (5000 if low == 0 else chunks))]
            list(best.add(np.arange(low, chunks), length[low:], own - [low, 0, 0, 0, 0]))
    finally:
        retrieval._Lists.scored = scored
    got = {b.column(0)[0].as_py(): (np.frombuffer(b.column(2)[0].as_py(), np.int64), np.frombuffer(b.column(3)[0].as_py())) for b in best.handed()}
    everything = 0
    for q, own in uses:
        total = np.zeros(chunks)
        for t in own:
            rows = found[found[:, 1] == t]
            total[rows[:, 0]] += best.worth(rows[:, 2:] @ np.array([2.0, 1.0, 1.0]), length[rows[:, 0]], t)
        some = np.flatnonzero(total)
        everything += len(some)
        want = some[np.lexsort((some, -np.round(total[some], 9)))[:k]]
        assert got[q][0].tolist() == want.tolist() and np.allclose(-got[q][1], total[want], atol=1e-12)
    assert sum(seen) < everything / 4


def test_a_golden_set_is_made_once_and_judged_without_a_frame_for_each_query(spark, tiny):
    from quarry.operators import evaluation

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    golden = catalogue.golden_set(spark, tiny).localCheckpoint()
    run = evaluation.evaluate(index.stored(spark, tiny), golden.mapInArrow(counted, golden.schema))
    assert run.metrics.count() > 0 and made.value == golden.count()
    assert "FlatMapGroups" not in run.metrics._jdf.queryExecution().toString()


def test_placeholders_are_told_as_by_the_pattern_alone(spark):
    from pyspark.sql import functions as F

    from quarry.functions.text import BOILERPLATE, is_boilerplate

    tails = ["", ".", "。", ", , ", "\t", " . . . . . . . . . . . . ", ".x", "............x", " x", "x.............."]
    texts = [(f"{pad}{b}{tail}",) for b in (*BOILERPLATE, "todo", "coming soon", "", "12 characters", "eleven char") for tail in tails for pad in ("", "  ", "\t", "a")] + [(None,)]
    bare = F.regexp_replace(F.trim("t"), r"[.。、, \t]+$", "")
    rows = spark.createDataFrame(texts, "t string").select("t", is_boilerplate(F.col("t")), F.upper(bare).isin([b.upper() for b in BOILERPLATE])).collect()
    assert all(a == b for _, a, b in rows) and sum(bool(a) for _, a, _ in rows) > 100
    plan = spark.createDataFrame(texts, "t string").where(is_boilerplate(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "substring(" in plan  # what tells most texts without the pattern


@pytest.mark.parametrize("table", [1 << 24, 0])
@pytest.mark.parametrize("least", [1, 3])
def test_phrases_are_found_without_an_object_for_each_place(table, least, monkeypatch):
    monkeypatch.setattr(retrieval, "PIECE", 7)
    monkeypatch.setattr(retrieval, "TABLE", table)
    r = np.random.default_rng(4)
    draw = lambda low, high: "".join(r.choice(list("abé 語x"), int(r.integers(low, high))))
    terms = list(dict.fromkeys(draw(least, 6) for _ in range(60)))
    fields = [[None if r.random() < 0.2 else draw(0, 40) for _ in range(50)] for _ in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(-3, 47)), *(pa.array([*"abc", *f], pa.string())[3:] for f in fields)], names=["chunk_id", "heading", "context", "content"])
    got, length = retrieval._occurrences(batch, retrieval._machine(terms), retrieval._sizes(terms))
    count = lambda text, t: sum(text.startswith(t, k) for k in range(len(text)))
    want = [[n, t, *c] for n in range(50) for t, x in enumerate(terms) if any(c := [count(f[n] or "", x) for f in fields])]
    assert sorted(got.tolist()) == sorted(want) and length.tolist() == [sum(max(len(f[n] or "") - 2, 0) for f in fields) for n in range(50)]
    assert not hasattr(retrieval._machine(terms), "iter")
    assert retrieval._occurrences(batch[:0], retrieval._machine(terms), retrieval._sizes(terms))[0].shape == (0, 5)


def test_a_query_is_scored_once_for_weights_that_its_fields_do_not_tell_apart(spark, monkeypatch):
    rows = [(n, "mill" if n % 7 == 0 else None, "stone" if n % 5 == 0 else "x", "river " * (n % 4) + "mill stone grain") for n in range(60)]
    chunks = spark.createDataFrame(rows, "id long, heading string, context_text string, content string")
    queries = spark.createDataFrame(list(enumerate(["river", "grain river", "stone", "mill stone", "none here"])), "query_id long, query string")
    triples = [(h, x, c) for h in (0.5, 2.0) for x in (1.0, 4.0) for c in (0.5, 1.0)]
    want = sorted((x["query_id"], x["weight_id"], x["rank"], x["chunk_id"]) for x in retrieval.bm25(chunks, queries, retrieval.weight_table(spark, *triples), 9).collect())
    seen, bests = {}, retrieval._bests
    monkeypatch.setattr(retrieval, "_bests", lambda found, k, idf, mean, uses, weights: seen.update({q: len(weights) for q, _ in uses}) or bests(found, k, idf, mean, uses, weights))
    got = []
    for x in retrieval.text_orders(chunks, queries, triples, 9).collect():
        got += [(x["query_id"], w, n, x["chunks"][at]) for w, own in enumerate(np.frombuffer(x["orders"], np.int32).reshape(8, 9)) for n, at in enumerate(own) if at >= 0]
    assert sorted(got) == want and seen == {0: 2, 1: 2, 2: 4, 3: 8}


def test_a_pass_lists_only_the_terms_of_its_queries():
    r = np.random.default_rng(3)
    terms = [f"term{t:02d}x" for t in range(12)]
    texts = [" ".join(r.choice(terms, 9)) for _ in range(200)] + ["term00x"] * 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.nulls(300, pa.string()), pa.nulls(300, pa.string()), pa.array(texts)], names=["chunk_id", "heading", "context", "content"])
    stored = list(retrieval._finder(terms)(iter([batch])))
    uses, seen, add = [(q, [q % 12, (q + 1 + q // 12) % 12]) for q in range(24)], [], retrieval._Best.add_lists
    retrieval._Best.add_lists = lambda self, keys, length, row, *a: seen.append(len(row)) or add(self, keys, length, row, *a)
    try:
        run = lambda some: [(q, c, x) for b in retrieval._scores(np.ones(12), 50.0, some, [(0, 1.0, 1.0, 1.0)], 7)(iter(stored)) for q, _, c, x in zip(*(col.to_pylist() for col in b.columns), strict=True)]
        want, (all_rows,) = run(uses), seen
        assert sorted(run(uses[:1]) + run(uses[1:])) == sorted(want)
    finally:
        retrieval._Best.add_lists = add
    own = [sum(f"term{t:02d}x" in x for x in texts) for t in uses[0][1]]
    assert seen[1] == sum(own) < all_rows / 3
    counted = {t: sum(f"term{t:02d}x" in x for x in texts) for t in range(12)}
    parts = list(retrieval._passes(uses, counted, 6))
    assert sorted(u for p in parts for u in p) == sorted(uses) and all(len(p) == 6 for p in parts)
    assert sum(any(0 in own for _, own in p) for p in parts) == 1  # the most frequent term is read once
