import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.model import Corpus
from quarry.operators import checks, maintenance
from quarry.sources import files, parsers, settings
from quarry.streaming import maintain


def test_markdown():
    text = "﻿---\r\ntitle: Guide\r\ndate: 2024-05-01\r\ntags: [a, 2]\r\nother: x\r\n---\r\nintro\r\n## One\r\n" + "long text " * 8 + "\n### Sub\nshort\n## Skip me\nhidden\n### Below\n" + "more words " * 8
    p = parsers.markdown(text.encode(), "g.md", ("Skip",))
    assert (p.title, p.date, p.tags) == ("Guide", "2024-05-01", ["a", "2"])
    assert [(c.heading, c.level, c.context) for c in p.chunks] == [(None, None, "Guide"), ("One", 2, "Guide > One"), ("Below", 3, "Guide > Skip me > Below")]
    assert p.chunks[1].content.endswith("\n\n## Sub\n\nshort")
    assert parsers.markdown(b"---\nbroken: [\n---\nbody", "x").chunks[0].content == "body" and parsers.markdown(b"").chunks == []
    assert [c.heading for c in parsers.markdown(b"```\n## not code\n```\n" + b"x" * 60).chunks] == [None, "not code"]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


CORE = '<c xmlns:dc="d" xmlns:t="t"><dc:title>Report</dc:title><t:created>2024-03-02T10:00:00Z</t:created><keywords>a, b</keywords></c>'


def test_office():
    w = 'xmlns:w="w"'
    doc = f'<w:document {w}><w:p><w:r><w:t>before</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:document>'
    p = parsers.docx(package({"word/document.xml": doc, "docProps/core.xml": CORE}), "x/y.docx")
    assert (p.title, p.date, p.tags) == ("Report", "2024-03-02", ["a", "b"]) and [(c.heading, c.level, c.content) for c in p.chunks] == [(None, None, "before"), ("Part", 2, "cell")]
    rels = '<R><Relationship Id="r1" Target="{}"/></R>'
    book = '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>4</v></c></row><row></row></sheetData></worksheet>'
    x = parsers.xlsx(package({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels.format("worksheets/s1.xml"), "xl/worksheets/s1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>"}), "my_book.xlsx")
    assert x.title == "my book" and [(c.heading, c.content) for c in x.chunks] == [("Sheet: S", "name\t\t4")]
    deck = '<p xmlns:r="r"><sldIdLst><sldId r:id="r1"/></sldIdLst></p>'
    slide = '<sld><sp><nvPr><ph type="title"/></nvPr><p><t>Hello</t></p></sp><sp><p><t>body</t></p></sp></sld>'
    s = parsers.pptx(package({"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rels.format("slides/s1.xml"), "ppt/slides/s1.xml": slide, "ppt/slides/_rels/s1.xml.rels": rels.format("../notesSlides/n1.xml"), "ppt/notesSlides/n1.xml": "<n><p><t>said</t></p></n>"}), "d.pptx")
    assert [(c.heading, c.content) for c in s.chunks] == [("Slide 1: Hello", "Hello\nbody\n[notes]\nsaid")]


def test_bad_files_are_error_rows():
    for ext in ("docx", "xlsx", "pptx"):
        error, doc = parsers.parse(b"not a zip", f"a.{ext}", parsers.registry((ext,)))
        assert error and doc is None
    with pytest.raises(ValueError):
        parsers.registry(("md", "odt"))
    with pytest.raises(ValueError):
        parsers.pdf_pages(["x"])
    assert parsers.pdf_pages(["some inter-\nnal text that is long enough to count as a page of a document"], "a-b.pdf").chunks[0].heading == "p.1"


def test_scan_and_parse(spark, tmp_path):
    for name, text in {"a/b/one.md": "## H\n" + "words " * 20, "two.MD": "plain", "skip/x.md": "no", ".git/y.md": "no", "a/~$lock.md": "no", "a/z.txt": "no", "old/keep.md": "kept", "old/drop.md": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "big.md").write_text("x" * 500)
    rows = files.scan(spark, str(tmp_path), folders=("skip",), ignore="old/*.md\n!old/keep.md\n", cap=400)
    assert {(r["path"], r["status"]) for r in rows.collect()} == {("a/b/one.md", "ok"), ("two.MD", "ok"), ("old/keep.md", "ok"), ("big.md", "oversize")}
    parsed = files.parsed(rows.where("status = 'ok'"))
    chunks = {r["path"]: r for r in files.chunk_rows(parsed).collect()}
    assert chunks["a/b/one.md"]["heading"] == "H" and (chunks["a/b/one.md"]["category"], chunks["a/b/one.md"]["topic"]) == ("a", "b") and chunks["two.MD"]["quality_score"] == 0.1
    assert files.document(rows, "two.MD") == ("plain", False) and files.document(rows, "two.MD", 3) == ("pla", True) and files.document(rows, "none") is None


def test_settings(spark):
    o = settings.search_options("[search]\nmin_confidence_ratio = 2.0\n[search.fusion]\nk = 20\n[search.mmr]\nenabled = true\nlam = 0.5\n")
    assert (o.min_confidence_ratio, o.fusion.k, o.mmr.enabled) == (2.0, 20, True)
    for bad in ("[search]\nx = 1", "[search.mmr]\nlam = 3", "[search.parent]\nfoo = 1"):
        with pytest.raises(ValueError):
            settings.search_options(bad)
    g = settings.golden(spark, "queries:\n- query: q\n  expected:\n  - path: a.md\n    heading: H\n").collect()
    assert g[0]["query"] == "q" and g[0]["expected"][0]["heading"] == "H"
    with pytest.raises(ValueError):
        settings.golden(spark, "queries: []\nother: 1")


def test_checks_and_maintenance(spark):
    docs = spark.createDataFrame([(1, "a.md", "A", 10, "h1"), (2, "b.md", None, None, "h2"), (3, "c.txt", "C", 10, "h2")], "id long, path string, title string, size_bytes long, content_hash string")
    chunks = spark.createDataFrame([(10, 1, 0, "x", 1.0, None), (11, 9, 0, "y" * 90, 1.0, "c")], "id long, document_id long, chunk_index int, content string, quality_score double, context_text string").withColumn("heading", F.lit(None).cast("string"))
    kb = Corpus(docs, chunks, spark.createDataFrame([(10, [1.0]), (99, [1.0])], "chunk_id long, embedding array<float>"))
    found = {r["check"]: (r["n"], r["samples"]) for r in checks.doctor(kb, spark.createDataFrame([(10,), (55,)], "chunk_id long"), cap=5).collect()}
    assert found == {"missing-embedding": (1, ["11"]), "orphan-embedding": (1, ["99"]), "chunk-without-document": (1, ["11"]), "document-without-chunks": (2, ["b.md", "c.txt"]), "missing-text-row": (1, ["11"]), "orphan-text-row": (1, ["55"]), "extension-not-registered": (1, ["c.txt"]), "larger-than-a-read-returns": (2, ["a.md", "c.txt"]), "size-not-recorded": (1, ["b.md"])}
    bad = checks.validate(docs.withColumn("tags", F.array(F.lit("q"))), (checks.FieldRule("title", required=True, pattern="^A"), checks.FieldRule("tags", enum=("z",)), checks.FieldRule("tags", type="string")))
    assert sorted((r["path"], r["kind"]) for r in bad.collect()) == sorted([("b.md", "missing"), ("c.txt", "pattern"), *((p, k) for p in ("a.md", "b.md", "c.txt") for k in ("enum", "type"))])
    assert checks.github_lines(bad).count() == 8
    for wrong in ({"name": "nope"}, {"name": "tags", "pattern": "x"}, {"name": "title", "type": "integer"}):
        with pytest.raises(ValueError):
            checks.FieldRule(**wrong)
    assert [r["quality_score"] for r in maintenance.backfill_quality(chunks).orderBy("id").collect()] == [0.1, 1.0]
    gone = maintenance.delete_documents(kb, spark.createDataFrame([("a.md",)], "path string"))
    assert gone.chunks.count() == 0 and gone.vectors.count() == 0
    assert maintenance.meta_only(chunks, chunks).select("same").distinct().collect() == [(True,)]
    v = maintenance.hashed_embedder(maintenance.missing_vectors(kb), 16).first()["embedding"]
    assert len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-5
    renamed = maintenance.rename(docs, spark.createDataFrame([("a.md", "z.md")], "old string, new string"))
    assert sorted(r["path"] for r in renamed.collect()) == ["b.md", "c.txt", "z.md"]
    assert maintenance.check_model({}, "m", 4) == {"model": "m", "dim": "4"}
    with pytest.raises(ValueError):
        maintenance.check_model({"model": "m", "dim": "4"}, "n", 4)
    assert maintenance.context_mode(None, "static", 5, False)[0] == "off" and maintenance.context_mode("static", "static", 5, False) == ("static", None) and maintenance.context_mode("off", "static", 5, True)[0] == "static"


def test_stream_equals_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp, kind string, path string, new_path string"
    rows = [(1, "a.md", "reindex", None), (2, "b.md", "reindex", None), (3, "a.md", "deindex", None), (4, "b.md", "rename", "c.md"), (5, "c.md", "rename", "c.tmp"), (6, "d.tmp", "rename", "d.md"), (7, "~$e.md", "reindex", None)]
    events = spark.createDataFrame([(k, p, d, n) for k, p, d, n in rows], "event_id long, path string, kind string, new_path string")
    events = events.select("event_id", F.timestamp_seconds(F.col("event_id") * 10).alias("ts"), "kind", "path", "new_path")
    source = tmp_path / "in"
    for part in (events.where("event_id < 4"), events.where("event_id >= 4")):
        part.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = maintain.maintain(stream, str(tmp_path / "state"), trigger={"availableNow": True})
    query.awaitTermination(120)
    n = max(int(p.name.split("-")[1]) for p in (tmp_path / "state").glob("state-*"))
    got = {r["path"] for r in maintain.last_state(spark, str(tmp_path / "state"), n).collect()}
    assert got == {r["path"] for r in maintain.batch_state(events).collect()} == {"d.md"}
