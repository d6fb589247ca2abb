"""The segmented index: a folder, changes to it, and a rebuild from nothing."""

import pytest
from pyspark.sql import functions as F

from quarry.model import Filters, SearchOptions
from quarry.operators.maintenance import hashed_embedder
from quarry.operators.retrieval import knn
from quarry.plans.search import search
from quarry.sources import index
from quarry.sources.postings import indexed_chunks


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text) if isinstance(text, bytes) else (root / name).write_text(text)


def page(*parts):
    return "".join(f"## Part {k}\n\n{p} and so it goes on for a while, with words enough to be a chunk of its own.\n\n" for k, p in enumerate(parts))


def content(kb):
    """All that does not depend on how the index came about: chunks with their vectors by path, and documents."""
    d = kb.documents.select(F.col("id").alias("document_id"), "path", "title", "topic", "category", "content_hash", "size_bytes")
    rows = kb.chunks.join(d, "document_id").join(kb.vectors.withColumnRenamed("chunk_id", "id"), "id", "left")
    out = rows.select("path", "title", "topic", "category", "content_hash", "chunk_index", "heading", "content", "context_text", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a * 3 + x), 4).alias("v"))
    return sorted(map(str, out.collect())), sorted(map(str, d.drop("document_id").collect()))


def answers(spark, kb):
    queries = spark.createDataFrame([(1, "river mill"), (2, "bread"), (3, "lighthouse"), (4, "words enough")], "query_id long, query string")
    options = SearchOptions(limit=20, filters=Filters(include_low_quality=True))
    hits = search(kb, queries, options).select("query_id", "path", "heading", F.round("score", 6).alias("score"))
    return sorted(map(str, hits.select("query_id", "path", "heading").collect()))


class Counting:
    def __init__(self):
        self.seen = 0

    def __call__(self, rows):
        self.seen += rows.count()
        return hashed_embedder(rows)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Each step's counters and corpus, and after each the same folder built from nothing."""
    root, folder = tmp_path_factory.mktemp("kb"), str(tmp_path_factory.mktemp("index"))
    put(root, {"a/river.md": page("The river", "The old mill"), "a/bread.md": page("Bread", "Salt"), "b/gone.md": page("To be deleted"), "b/name.md": "---\ntitle: Named\n---\n" + page("A lighthouse"), "b/front.md": "---\ntitle: Front\ntopic: x\n---\n" + page("Same body")})
    steps, embed = [], Counting()

    def step(name, **kw):
        before, embed.seen = index.versions(spark, folder), 0
        kb = index.rebuild(spark, str(root), folder, embed=embed, **kw)
        fresh = index.rebuild(spark, str(root), str(tmp_path_factory.mktemp("fresh")))
        steps.append((name, kb, fresh, index.meta_of(spark, folder), embed.seen, before != index.versions(spark, folder)))

    step("new")
    step("replay")
    (root / "b/gone.md").unlink()
    (root / "b/name.md").rename(root / "a/moved.md")
    put(root, {"a/river.md": page("The river", "The new bridge"), "b/front.md": "---\ntitle: Front\ntopic: y\n---\n" + page("Same body"), "c/added.md": page("Another lighthouse"), "c/bad.md": b"\xff\xfe\x00broken"})
    step("change")
    step("again")
    return root, folder, {n: rest for n, *rest in steps}


@pytest.mark.parametrize("name", ["new", "replay", "change", "again"])
def test_equals_a_rebuild(spark, run, name):
    kb, fresh, *_ = run[2][name]
    assert content(kb) == content(fresh) and answers(spark, kb) == answers(spark, fresh)
    assert (kb.text.chunks, kb.text.length) == (fresh.text.chunks, fresh.text.length)
    listed = {r[0] for r in indexed_chunks(kb.text).collect()}
    assert listed == {r["id"] for r in kb.chunks.select("id").collect()} == {r["chunk_id"] for r in kb.vectors.select("chunk_id").collect()}


def test_neighbours_leave_ended_chunks_out(spark, run):
    kb = run[2]["change"][0]
    q = kb.vectors.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")).limit(5)
    a, b = (sorted(map(str, knn(kb.vectors, q, 3, c).collect())) for c in (kb.cells, None))
    assert a == b and len(a) == 15


def test_counters_and_embedding(run):
    _, _, meta, seen, wrote = run[2]["new"]
    assert wrote and meta["counters"] == {"updated": 5, "renamed": 0, "deleted": 0, "skipped": 0, "embedded": seen, "meta_only": 0, "total_chunks": seen, "total_documents": 5}
    *_, seen, wrote = run[2]["replay"]
    assert not wrote and seen == 0
    _, _, meta, seen, wrote = run[2]["change"]
    c = meta["counters"]
    assert wrote and (c["renamed"], c["deleted"], c["total_documents"]) == (1, 1, 5 + (c["updated"] == 4))
    assert c["embedded"] == seen and c["meta_only"] >= 1 and 0 < seen < c["total_chunks"]
    assert not run[2]["again"][4]


def test_an_earlier_snapshot_stays(spark, run):
    _, folder, steps = run
    old = index.open_index(spark, folder, version=1)
    assert content(old) == content(steps["new"][0]) and {r["path"] for r in old.documents.collect()} >= {"b/gone.md", "b/name.md"}


def test_ids_last_over_revisions(spark, run):
    _, folder, steps = run
    ids = lambda kb: {r["path"]: r["id"] for r in kb.documents.collect()}
    old, new = ids(index.open_index(spark, folder, version=1)), ids(steps["change"][0])
    assert old["a/river.md"] == new["a/river.md"] and old["b/name.md"] == new["a/moved.md"] and new["c/added.md"] not in old.values()


def test_only_some_paths(spark, run, tmp_path):
    root, folder, _ = run
    put(root, {"a/bread.md": page("Rye", "Salt"), "c/unseen.md": page("Not told of")})
    (root / "c/added.md").unlink()
    kb = index.rebuild(spark, str(root), folder, only=["a/bread.md", "c/added.md", "nowhere.md"])
    paths = {r["path"] for r in kb.documents.collect()}
    assert "c/added.md" not in paths and "c/unseen.md" not in paths and kb.chunks.where("content like '%Rye%'").count() >= 1
    (root / "c/unseen.md").unlink()
    assert content(kb) == content(index.rebuild(spark, str(root), str(tmp_path / "fresh")))


def test_compaction_keeps_all(spark, run):
    _, folder, _ = run
    before = index.open_index(spark, folder)
    rows, said = content(before), answers(spark, before)
    kb = index.compact(spark, folder)
    meta = index.meta_of(spark, folder)
    assert len(meta["segments"]) == 1 and not meta["dead"] and content(kb) == rows and answers(spark, kb) == said
    assert index.drop_unused(spark, folder) and content(index.open_index(spark, folder)) == rows and index.versions(spark, folder) == [meta["version"]]


def test_models_and_other_writers(spark, run, monkeypatch):
    root, folder, _ = run
    with pytest.raises(ValueError, match="rebuild with force"):
        index.rebuild(spark, str(root), folder, model="other")
    kb = index.rebuild(spark, str(root), folder, model="other", force=True)
    assert index.meta_of(spark, folder)["model"] == "other" and index.meta_of(spark, folder)["counters"]["embedded"] == kb.chunks.count()
    with pytest.raises(RuntimeError, match="another writer"):
        index._commit(spark, folder, index.meta_of(spark, folder))


def test_a_stream_of_events_keeps_the_index_up(spark, tmp_path):
    from quarry.streaming.maintain import maintain_index

    root, folder, inbox = tmp_path / "kb", str(tmp_path / "index"), tmp_path / "events"
    put(root, {"a.md": page("One"), "b.md": page("Two"), "c.md": page("Three")})
    index.rebuild(spark, str(root), folder)
    schema = "event_id long, ts timestamp, kind string, path string, new_path string"

    def told(*events):
        rows = spark.createDataFrame([(k, None, *e) for k, e in enumerate(events)], schema)
        rows.coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        maintain_index(stream, str(root), folder, str(tmp_path / "checkpoint"), trigger={"availableNow": True}).awaitTermination(120)
        return index.meta_of(spark, folder)

    put(root, {"a.md": page("One", "More")})
    (root / "b.md").rename(root / "d.md")
    (root / "c.md").unlink()
    meta = told(("reindex", "a.md", None), ("rename", "b.md", "d.md"), ("deindex", "c.md", None))
    assert {k: meta["counters"][k] for k in ("updated", "renamed", "deleted")} == {"updated": 1, "renamed": 1, "deleted": 1}
    kb = index.open_index(spark, folder)
    assert content(kb) == content(index.rebuild(spark, str(root), str(tmp_path / "fresh")))
    assert told(("reindex", "a.md", None), ("rename", "b.md", "d.md"))["version"] == meta["version"]


def test_rules_are_read_again(spark, tmp_path):
    root, folder = tmp_path / "kb", str(tmp_path / "index")
    put(root, {"a.md": page("One"), "b/x.md": page("Two"), "b/y.md": page("Three")})
    paths = lambda kb: {r["path"] for r in kb.documents.select("path").collect()}
    assert paths(index.rebuild(spark, str(root), folder)) == {"a.md", "b/x.md", "b/y.md"}
    put(root, {".quarryignore": "b/*\n!b/y.md\n"})
    kb = index.rebuild(spark, str(root), folder, only=["a.md"])  # the rules reach farther than the event
    assert paths(kb) == {"a.md", "b/y.md"} and index.meta_of(spark, folder)["counters"]["deleted"] == 1
    (root / "b/x.md").unlink()
    put(root, {".quarryignore": "nothing/*\n"})
    version = index.meta_of(spark, folder)["version"]
    assert paths(index.rebuild(spark, str(root), folder, only=["a.md"])) == {"a.md", "b/y.md"}
    assert index.meta_of(spark, folder)["version"] == version + 1  # the new rules change nothing but are known now
    index.rebuild(spark, str(root), folder, only=["a.md"])
    assert index.meta_of(spark, folder)["version"] == version + 1
