"""Hand-made cases of rules for metadata, scripts, exclusions, late events, numbering, the stored index and the sweep's guards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import storage
from quarry.functions.query_compiler import script
from quarry.model import Filters, SearchOptions
from quarry.operators import checks, evaluation, tuning
from quarry.plans.search import search
from quarry.sources import index
from quarry.sources.files import excluded
from quarry.sources.settings import golden_defaults
from quarry.streaming import maintain

DOCUMENT = "path string, title string, date string, topic string, depth string, tags array<string>"


def broken(spark, rule, **values):
    row = {"path": "a.md", "title": None, "date": None, "topic": None, "depth": None, "tags": None} | values
    docs = spark.createDataFrame([tuple(row.values())], DOCUMENT)
    return [r["kind"] for r in checks.validate(docs, (rule,)).collect()]


@pytest.mark.parametrize(
    ("rule", "values", "kinds"),
    [
        (checks.FieldRule("title", min_length=3), {"title": ""}, ["length"]),
        (checks.FieldRule("title", min_length=3), {"title": None}, []),
        (checks.FieldRule("title", pattern="^x"), {"title": ""}, ["pattern"]),
        (checks.FieldRule("title", enum=("x",)), {"title": ""}, ["enum"]),
        (checks.FieldRule("title", required=True), {"title": "  "}, []),
        (checks.FieldRule("title", required=True, min_length=1), {"title": ""}, ["missing"]),
        (checks.FieldRule("title", required=True, allow_empty=True, min_length=1), {"title": ""}, ["length"]),
        (checks.FieldRule("title", required=True, allow_empty=True), {"title": None}, ["missing"]),
        (checks.FieldRule("title", type="array", required=True), {"title": None}, ["type"]),
        (checks.FieldRule("tags", min_length=1), {"tags": []}, ["length"]),
        (checks.FieldRule("tags", min_length=1), {"tags": None}, ["length"]),
        (checks.FieldRule("tags", required=True, min_length=1), {"tags": []}, ["missing"]),
        (checks.FieldRule("tags", type="string"), {"tags": None}, ["type"]),
        (checks.FieldRule("tags", enum=("a",), max_length=1), {"tags": ["a", "b", "c"]}, ["enum", "enum", "length"]),
    ],
)
def test_rules(spark, rule, values, kinds):
    assert sorted(broken(spark, rule, **values)) == kinds


@pytest.mark.parametrize(("c", "kind"), [("\uf900", "kanji"), ("\U0002f800", "kanji"), ("々", "kanji"), ("・", "katakana"), ("゠", "gap"), ("ァ", "katakana"), ("ー", "katakana"), ("ﾟ", "katakana"), ("･", "gap"), ("ぁ", "hiragana"), ("한", "word"), ("Ａ", "word"), ("-", "word"), (" ", "gap")])
def test_scripts(c, kind):
    assert script(c) == kind


def test_exclusions(spark):
    paths = ["a.md", ".git/a.md", ".svn/a.md", "x/node_modules/a.md", ".obsidian/a.md", ".vscode/a.md", ".idea/a.md", "target/a.md", ".trash/a.md", ".venv/a.md", "own/a.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    left = lambda **k: {r[0] for r in rows.where(~excluded(F.col("path"), **k)).collect()}
    assert left() == {"a.md", ".trash/a.md", ".venv/a.md", "own/a.md"}
    assert left(folders=("own",)) == set(paths) - {".git/a.md", ".svn/a.md", "x/node_modules/a.md", "own/a.md"}
    assert left(folders=()) == set(paths) - {".git/a.md", ".svn/a.md", "x/node_modules/a.md"}


def events(spark, rows):
    e = spark.createDataFrame(rows, "event_id long, t long, kind string, path string, new_path string")
    return e.select("event_id", F.timestamp_seconds("t").alias("ts"), "kind", "path", "new_path")


def test_late_events_do_not_revive(spark, tmp_path):
    parts = [[(1, 10, "reindex", "a.md", None), (2, 20, "deindex", "a.md", None)], [(3, 15, "reindex", "a.md", None), (4, 15, "reindex", "b.md", None)], [(5, 16, "deindex", "b.md", None), (6, 12, "reindex", "b.md", None), (7, 30, "reindex", "c.md", None)]]
    for k, rows in enumerate(parts):
        events(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("event_id long, ts timestamp, kind string, path string, new_path string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    maintain.maintain(stream, str(tmp_path / "out"), trigger={"availableNow": True}).awaitTermination(120)
    states = [{r["path"] for r in maintain.last_state(spark, str(tmp_path / "out"), n).collect()} for n in range(3)]
    assert states[-1] == {"c.md"} and all("a.md" not in s for s in states)
    before = maintain.last_events(spark.createDataFrame([], "path string, ts timestamp, event_id long, live boolean"), maintain.classify(events(spark, parts[0])))
    assert maintain.merge(before, maintain.classify(events(spark, parts[1]))).select("path").collect() == [("b.md",)]


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select(F.sha1(F.col("id").cast("string")).alias("k"))
    got = [(r["k"], r["n"]) for r in storage.numbered(rows, "k", "n", 5).collect()]
    assert sorted(got) == [(k, n) for n, k in enumerate(sorted(k for k, _ in got), 5)]
    assert storage.numbered(rows.limit(0), "k", "n").count() == 0


def test_tables_are_dropped(spark):
    before = set(storage.written(spark))
    t = storage.durable(spark.range(3), "drop")
    (path,) = set(storage.written(spark)) - before
    assert t.count() == 3
    storage.drop_tables(spark, [path])
    assert path not in storage.written(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_rebuild_from_a_folder(spark, tmp_path):
    root, folder = tmp_path / "kb", str(tmp_path / "index")
    for name, text in {"notes/river/a.md": "---\ntitle: River\n---\n# One\n\nThe river runs past the old mill and on to the sea, slowly.\n", "notes/b.md": "# Two\n\nBread is made of flour, water, salt and yeast, and then time.\n", ".git/c.md": "# no\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    kb = index.rebuild(spark, str(root), folder)
    docs = {r["path"]: r for r in kb.documents.collect()}
    assert set(docs) == {"notes/river/a.md", "notes/b.md"} and docs["notes/river/a.md"]["title"] == "River" and docs["notes/river/a.md"]["topic"] == "river"
    assert kb.chunks.count() == kb.vectors.count() > 1 and index.meta_of(spark, folder)["model"] == "hashed-64"
    again = index.open_index(spark, folder)
    hits = search(again, spark.createDataFrame([(1, "old mill")], "query_id long, query string"), SearchOptions(limit=3, filters=Filters(include_low_quality=True))).collect()
    assert hits[0]["path"] == "notes/river/a.md"
    other = index.reset_for_model(spark, folder, str(tmp_path / "new"), lambda rows: rows.select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding")), "one")
    assert other.vectors.count() == kb.vectors.count() and index.meta_of(spark, str(tmp_path / "new"))["model"] == "one" and index.meta_of(spark, str(tmp_path / "none")) == {}
    golden = spark.createDataFrame([(1, "old mill", [("notes/river/a.md", None)])], "query_id long, query string, expected array<struct<path:string,heading:string>>")
    run = evaluation.evaluate(again, golden, SearchOptions(limit=1, filters=Filters(include_low_quality=True)), (1, 3))
    assert run.limit == 3 and {(r["metric"], r["k"]): r["value"] for r in run.aggregate.collect()} == {("recall", 1): 1.0, ("recall", 3): 1.0, ("rr", 0): 1.0, ("ndcg", 1): 1.0, ("ndcg", 3): 1.0}


def test_previous_run(spark):
    history = spark.createDataFrame([("a", "2024-01-01", "f"), ("b", "2024-01-02", "f"), ("c", "2024-01-03", "g"), ("d", "2024-01-04", "f")], "run_id string, started string, fingerprint string")
    assert [r["run_id"] for r in evaluation.previous_run(history, "f", "2024-01-04").collect()] == ["b"]
    assert evaluation.previous_run(history, "h", "2024-01-04").count() == 0


def test_decision_guards():
    default, best = tuning.default_condition(), tuning.grid().index((4.0, 1.0, 1.0, 60.0))
    values = np.full((12, len(tuning.grid())), 0.2)
    values[:, best] = 0.9
    assert tuning.decide(values)["adopt"]
    worse = {default: {("recall", 5): 0.8, ("rr", 0): 0.5}, best: {("recall", 5): 0.7, ("rr", 0): 0.6}}
    out = tuning.decide(values, worse)
    assert not out["adopt"] and out["reasons"] == ["degraded: recall@5 0.7000 < 0.8000"] and out["improved"] == 12 and out["worst_query"] is None
    assert not tuning.decide(np.zeros((0, len(tuning.grid()))))["adopt"]


def test_golden_defaults():
    assert golden_defaults("defaults: {limit: 7}\nqueries: []") == {"limit": 7} and golden_defaults("queries: []") == {}
