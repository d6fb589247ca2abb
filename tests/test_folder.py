"""Checked reads, folder events, and what is rendered."""

import os

import pytest

from quarry.functions import text
from quarry.operators import checks
from quarry.plans import render
from quarry.sources import folder, parsers
from quarry.streaming import maintain


@pytest.fixture
def kb(tmp_path):
    root = tmp_path / "kb"
    for name in ("a.md", "x/b.md", "x/~$b.md", ".git/c.md", "x/d.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    return root


def test_checked_reads(kb):
    os.symlink(kb / "a.md", kb / "link.md")
    os.link(kb / "x/b.md", kb / "hard.md")
    assert folder.read_checked(str(kb / "a.md")) == b"text of a.md"
    assert [folder.read_checked(str(kb / n), 4).reason for n in ("link.md", "hard.md", "a.md", "x")] == ["not-plain", "multi-linked", "too-large", "not-plain"]
    with pytest.raises(FileNotFoundError):
        folder.read_checked(str(kb / "none.md"))
    assert [p for p, _ in folder.walk(str(kb))] == ["a.md"]
    assert [p for p, _ in folder.walk(str(kb), ("md", "txt"))] == ["a.md", "x/d.txt"]


def test_one_document(kb):
    os.symlink(kb / "x", kb / "y")
    assert folder.document_text(str(kb), "a.md") == ("text of a.md", False) and folder.document_text(str(kb), "a.md", cap=4) == ("text", True)
    assert [folder.document_text(str(kb), p).reason for p in ("y/b.md", "../kb2/a.md", "x/d.txt")] == ["not-plain", "not-plain", "extension"]


def test_changes():
    old = {"a": [1, 5, 9], "b": [2, 5, 9], "c": [3, 5, 9]}
    assert folder.changes(old, {"a": [1, 5, 9], "d": [2, 5, 9], "c": [3, 6, 10]}) == [("rename", "b", "d"), ("reindex", "c", None)]
    assert folder.changes(old, {}) == [("deindex", p, None) for p in "abc"] and folder.changes({}, old)[0] == ("reindex", "a", None)


def test_folder_stream(spark, kb, tmp_path):
    reader = folder.FolderReader({"path": str(kb)})
    first, end = reader.read(reader.initialOffset())
    assert [(e[2], e[3]) for e in first] == [("reindex", "a.md"), ("reindex", "x/b.md")]
    assert reader.read(end)[1] == end and not list(reader.read(end)[0])
    os.rename(kb / "a.md", kb / "new.md")
    (kb / "x/b.md").unlink()
    again, later = reader.read(end)
    assert [(e[2], e[3], e[4]) for e in again] == [("rename", "a.md", "new.md"), ("deindex", "x/b.md", None)]
    assert [e[2:] for e in reader.readBetweenOffsets(end, later)] == [("rename", "a.md", "new.md"), ("deindex", "x/b.md", None)]
    spark.dataSource.register(folder.FolderSource)
    events = spark.readStream.format("quarry_folder").option("path", str(kb)).load()
    query = maintain.maintain(events, str(tmp_path / "state"), trigger={"processingTime": "200 milliseconds"})
    try:
        for _ in range(200):
            query.processAllAvailable()
            if query.lastProgress:
                break
        number = max(int(p.name.split("-")[1]) for p in (tmp_path / "state").glob("state-*"))
        assert {r["path"] for r in maintain.last_state(spark, str(tmp_path / "state"), number).collect()} == {"new.md"}
    finally:
        query.stop()


def test_pdf_gates():
    japanese = "".join(chr(b) for c in "検索の仕組みを説明する文書です" for b in c.encode("utf-16-be"))
    assert parsers.paired_bytes([japanese.replace(" ", "x")]) >= 0 and parsers.paired_bytes(["An ordinary page of English prose, nothing else."]) == 0
    kana = " ".join("".join("0" + c for c in w) for w in ("ABC", "DEF", "GHI", "JKL", "MNO", "PQR"))
    assert parsers.paired_bytes([kana]) == 1.0 and parsers.paired_bytes(["0A0B0C0D0E"]) == 1.0 and parsers.paired_bytes(["1A2B3C4D5E", "10101010"]) == 0.0
    with pytest.raises(ValueError, match="decoded"):
        parsers.pdf_pages([kana * 3])
    garbled = b"\xfe\xff" + "日本の題".encode("utf-16-be")
    title = "".join(bytes([b]).decode("cp1252", "replace") for b in garbled)
    assert "\ufffd" in title or parsers.repaired_title(title) == "日本の題"
    assert parsers.repaired_title("\u00fe\u00ff" + "\x00A\x00b") == "Ab" and parsers.repaired_title("\u00fe\u00ffabc") is None and parsers.repaired_title("  x ") == "x" and parsers.repaired_title("\u00fe\u00ff\x00\x01") is None
    page = "The ﬁrst eﬀort took a long time and re-\nquired patience from everybody at the river."
    out = parsers.pdf_pages([page], "a.pdf", date="D:20240131120000")
    assert out.date == "2024-01-31" and out.chunks[0].content.startswith("The first effort took a long time and required")


def test_small_functions():
    assert text.days_before("2024-03-01", 1) == "2024-02-29"
    assert text.template_paths(("best/{target}/x.md", "{target}.md", "/{target}"), "../a") == [] and text.template_paths(("best/{target}/x.md",), "a") == ["best/a/x.md"]
    assert text.fit_width("short", 12, 100) == "short"
    for s in ("i" * 200, "検索" * 60, "Wide MMM " * 20):
        cut = text.fit_width(s, 12, 120)
        assert cut.endswith("…") and text.text_width(cut, 12) <= 120 + 1e-9 and s.startswith(cut[:-1])


def test_rendering(spark):
    hits = spark.createDataFrame([(1, 1, "b.md", None, 0.1, False), (1, 0, "a.md", "H", 0.2, False)], "query_id long, rank int, path string, heading string, score double, low_confidence boolean")
    (row,) = render.search_json(hits).collect()
    assert row["json"] == '{"results":[{"rank":0,"path":"a.md","heading":"H","score":0.2},{"rank":1,"path":"b.md","score":0.1}],"low_confidence":false}'
    findings = spark.createDataFrame([("x", "warning", 2, ["a", "b"]), ("y", "error", 1, ["c"]), ("z", "error", 0, [])], "check string, severity string, n long, samples array<string>")
    assert [r["line"] for r in render.check_lines(findings).collect()] == ["error: y: 1 (c)", "warning: x: 2 (a, b)"]
    docs = spark.createDataFrame([("best/b.md",), ("c.md",)], "path string")
    assert render.best_practice(docs, ("none/{target}.md", "best/{target}.md", "{target}.md"), "b") == "best/b.md" and render.best_practice(docs, ("{target}.md",), "q") is None


def test_vector_table_missing(spark):
    from quarry.model import Corpus

    docs = spark.createDataFrame([(1, "a.md", 10)], "id long, path string, size_bytes long")
    chunks = spark.createDataFrame([(k, 1) for k in range(8)], "id long, document_id long")
    out = {r["check"]: (r["n"], r["samples"]) for r in checks.doctor(Corpus(docs, chunks, spark.createDataFrame([], "chunk_id long"))).collect()}
    assert out["vector-table-missing"] == (1, ["8 chunks"]) and out["missing-embedding"] == (8, ["0", "1", "2", "3", "4"]) and out["orphan-embedding"] == (0, [])
