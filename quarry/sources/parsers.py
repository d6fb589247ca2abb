"""Document parsers: bytes of a file to a title, metadata and chunks. One bad file gives one error row and never fails a job."""

from __future__ import annotations

import io
import json
import re
import unicodedata
import zipfile
from collections import Counter
from dataclasses import dataclass, field
from datetime import date, datetime
from xml.etree import ElementTree

from quarry.functions.text import LIGATURES

# Limits that users see.
LEAST_CHUNK = 50
MOST_BYTES, MOST_PART, MOST_UNPACKED = 50 << 20, 1 << 20, 200 << 20


@dataclass
class Chunk:
    index: int
    heading: str | None
    level: int | None
    content: str
    context: str | None = None


@dataclass
class Parsed:
    title: str | None = None
    date: str | None = None
    topic: str | None = None
    depth: str | None = None
    tags: list[str] = field(default_factory=list)
    chunks: list[Chunk] = field(default_factory=list)


def trail(parts: list[str | None], size: int = 200) -> str | None:
    kept: list[str] = []
    for p in parts:
        p = (p or "").strip()
        if p and (not kept or kept[-1] != p):
            kept.append(p)
    return " > ".join(kept)[:size] or None


def decode(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n")


def file_title(name: str) -> str:
    stem = name.rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem[1:] else stem
    return " ".join(re.sub("[-_]", " ", stem).split())


def _scalar(value) -> str | None:
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, (datetime, date)):
        return value.isoformat()[:10]
    return str(value)


def frontmatter(text: str) -> tuple[dict, str]:
    """(metadata, body): YAML between --- fences at the start; unknown keys are ignored, broken YAML counts as none."""
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        return {}, text
    end = next((k for k in range(1, len(lines)) if lines[k].rstrip() == "---"), None)
    if end is None:
        return {}, text
    try:
        import yaml

        meta = yaml.safe_load("\n".join(lines[1:end]))
    except Exception:
        meta = None
    return meta if isinstance(meta, dict) else {}, "\n".join(lines[end + 1 :])


def markdown(raw: bytes, name: str = "", exclude: tuple[str, ...] = ()) -> Parsed:
    """Sections at '## ' and '### ' lines. Sections whose heading holds an excluded text are left out, though they stay in the trail of those below.
    A section under 50 bytes joins the one before it under its heading as '## '; the first never does."""
    meta, body = frontmatter(decode(raw))
    tags = meta.get("tags")
    out = Parsed(_scalar(meta.get("title")), _scalar(meta.get("date")), _scalar(meta.get("topic")), _scalar(meta.get("depth")), [s for t in tags if (s := _scalar(t))] if isinstance(tags, list) else [])
    sections: list[tuple[str | None, int | None, list[str], str | None]] = []
    heading, level, lines, above, skip = None, None, [], None, False

    def flush() -> None:
        if not skip and "\n".join(lines).strip():
            sections.append((heading, level, list(lines), trail([out.title, above if level == 3 else None, heading])))

    second = None
    for line in body.split("\n"):
        m = re.match(r"(#{2,3}) (.*)$", line.strip())
        if m:
            flush()
            level, heading, lines = len(m[1]), m[2].strip(), []
            if level == 2:
                second = heading
            above, skip = second, any(x in heading for x in exclude)
        else:
            lines.append(line)
    flush()
    for h, lv, ls, context in sections:
        content = "\n".join(ls).strip()
        if out.chunks and len(content.encode()) < LEAST_CHUNK:
            out.chunks[-1].content += f"\n\n## {h}\n\n{content}" if h else f"\n\n{content}"
        else:
            out.chunks.append(Chunk(len(out.chunks), h, lv, content, context))
    return out


def plain(raw: bytes, name: str = "", exclude: tuple[str, ...] = ()) -> Parsed:
    text, title = decode(raw).strip(), file_title(name)
    return Parsed(title, chunks=[Chunk(0, None, None, text, trail([title]))] if text else [])


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


class Package:
    """An Office file: parts are read within a budget of unpacked bytes."""

    def __init__(self, raw: bytes):
        self.zip, self.left = zipfile.ZipFile(io.BytesIO(raw)), MOST_UNPACKED

    def xml(self, name: str):
        try:
            info = self.zip.getinfo(name)
        except KeyError:
            return None
        self.left -= info.file_size
        if self.left < 0:
            raise ValueError("too large when unpacked")
        return ElementTree.fromstring(self.zip.read(name))

    def core(self, name: str) -> Parsed:
        root, out = self.xml("docProps/core.xml"), Parsed(file_title(name))
        found = {_tag(e): (e.text or "").strip() for e in root.iter()} if root is not None else {}
        out.title = found.get("title") or out.title
        when = found.get("created") or found.get("modified") or ""
        out.date = when[:10] if re.match(r"\d{4}-\d{2}-\d{2}", when) else None
        out.tags = [t.strip() for t in re.split("[,;]", found.get("keywords", "")) if t.strip()]
        return out

    def links(self, name: str) -> dict[str, str]:
        folder, base = name.rsplit("/", 1)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        out = {}
        for e in root if root is not None else ():
            target = e.get("Target", "")
            parts: list[str] = [] if target.startswith("/") else folder.split("/")
            for p in target.lstrip("/").split("/"):
                if p == "..":
                    parts = parts[:-1]
                else:
                    parts.append(p)
            out[e.get("Id", "")] = "/".join(parts)
        return out


def docx(raw: bytes, name: str = "", exclude: tuple[str, ...] = ()) -> Parsed:
    package = Package(raw)
    out = package.core(name)
    root = package.xml("word/document.xml")
    stack: list[tuple[int, str]] = []
    section: tuple[str | None, int | None, list[str]] = (None, None, [])

    def flush() -> None:
        text = "\n".join(section[2]).strip()
        if text and not (section[0] and any(x in section[0] for x in exclude)):
            out.chunks.append(Chunk(len(out.chunks), section[0], section[1], text, trail([out.title, *(h for _, h in stack)])))

    for p in root.iter() if root is not None else ():
        if _tag(p) != "p":
            continue
        text = "".join((e.text or "") if _tag(e) == "t" else "\t" if _tag(e) == "tab" else "\n" if _tag(e) == "br" else "" for e in p.iter())
        style = next((v for e in p.iter() if _tag(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
        m = re.fullmatch(r"[Hh]eading ?(\d)", style)
        if m and text.strip():
            flush()
            level = min(6, int(m[1]) + 1)
            stack = [(lv, h) for lv, h in stack if lv < level] + [(level, text.strip())]
            section = (text.strip(), level, [])
        elif text.strip():
            section[2].append(text)
    flush()
    return out


def xlsx(raw: bytes, name: str = "", exclude: tuple[str, ...] = ()) -> Parsed:
    package = Package(raw)
    out = package.core(name)
    book, links = package.xml("xl/workbook.xml"), package.links("xl/workbook.xml")
    strings = package.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in strings] if strings is not None else []
    for sheet in (e for e in book.iter() if _tag(e) == "sheet") if book is not None else ():
        target = next((links.get(v) for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        root = package.xml(target) if target else None
        rows, size = [], 0
        for row in (e for e in root.iter() if _tag(e) == "row") if root is not None else ():
            cells: list[str] = []
            for c in (e for e in row if _tag(e) == "c"):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = 0
                for ch in letters[0] if letters else "":
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (min(at, 16_384) - 1 - len(cells))
                value = next((e.text or "" for e in c if _tag(e) == "v"), "")
                kind = c.get("t")
                if kind == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                cells.append(value)
            line = "\t".join(cells).rstrip("\t")
            size += len(line.encode()) + 1
            if size > MOST_PART:
                break
            if line.strip():
                rows.append(line)
        heading = f"Sheet: {sheet.get('name', '')}"
        if rows and not any(x in heading for x in exclude):
            out.chunks.append(Chunk(len(out.chunks), heading, 2, "\n".join(rows), trail([out.title, heading])))
    return out


def _paragraphs(root) -> list[str]:
    return [t for p in root.iter() if _tag(p) == "p" and (t := "".join(e.text or "" for e in p.iter() if _tag(e) == "t").strip())]


def pptx(raw: bytes, name: str = "", exclude: tuple[str, ...] = ()) -> Parsed:
    package = Package(raw)
    out = package.core(name)
    deck, links = package.xml("ppt/presentation.xml"), package.links("ppt/presentation.xml")
    ids = [v for e in deck.iter() if _tag(e) == "sldId" for k, v in e.attrib.items() if k.endswith("}id")] if deck is not None else []
    for n, key in enumerate(ids, 1):
        slide = package.xml(links.get(key, ""))
        if slide is None or slide.get("show") == "0":
            continue
        title = next((" ".join(_paragraphs(s)) for s in slide.iter() if _tag(s) == "sp" and any(_tag(e) == "ph" and e.get("type") in ("title", "ctrTitle") for e in s.iter())), "")
        lines = _paragraphs(slide)
        notes = next((package.xml(t) for t in package.links(links[key]).values() if "/notesSlides/" in t), None)
        if notes is not None and (said := _paragraphs(notes)):
            lines += ["[notes]", *said]
        heading = f"Slide {n}: {title}" if title else f"Slide {n}"
        if lines and not any(x in heading for x in exclude):
            out.chunks.append(Chunk(len(out.chunks), heading, 2, "\n".join(lines), trail([out.title, heading])))
    return out


# A run of this length is judged by itself, shorter ones together, if they make this many pairs with this many different second characters.
_OWN_RUN, _LEAST_PAIRS, _LEAST_SECONDS, _TOP_SHARE, _MOST_SUSPECT = 8, 12, 6, 0.9, 0.3


def paired_bytes(pages: list[str]) -> float:
    """The share of characters that look like two-byte text read byte by byte: in pairs whose first character hardly varies while the second does."""
    runs = [r for p in pages for r in p.split()]
    narrow = [r for r in runs if len(r) >= 2 and max(map(ord, r)) < 0x100]
    suspect = sum(len(r) for r in narrow if len(r) >= _OWN_RUN and len(set(r[::2])) <= 2 and len(set(r[1::2])) >= 4)
    short = [r for r in narrow if len(r) < _OWN_RUN]
    pairs = [r[k : k + 2] for r in short for k in range(0, len(r) - 1, 2)]
    firsts = Counter(p[0] for p in pairs)
    if len(pairs) >= _LEAST_PAIRS and len({p[1] for p in pairs}) >= _LEAST_SECONDS and sum(n for _, n in firsts.most_common(2)) >= _TOP_SHARE * len(pairs):
        suspect += sum(map(len, short))
    return suspect / max(1, sum(map(len, runs)))


def repaired_title(title: str | None) -> str | None:
    """A title whose UTF-16 bytes were read as single characters, put right; one that can't be is null, others are trimmed."""
    text = (title or "").strip()
    if not text.startswith("\u00fe\u00ff"):
        return text or None
    try:
        out = text[2:].encode("cp1252").decode("utf-16-be")
    except UnicodeError:
        return None
    return out if out.strip() and not any(unicodedata.category(c) == "Cc" for c in out) else None


def pdf_pages(pages: list[str], name: str = "", title: str | None = None, date: str | None = None) -> Parsed:
    """Chunks of extracted page texts. Text that looks wrongly decoded, or is under 50 characters a page on average, is an error."""
    whole = "".join(pages)
    if sum(0x80 <= ord(c) < 0xA0 for c in whole) >= 0.01 * max(1, len(whole)) or paired_bytes(pages) >= _MOST_SUSPECT:
        raise ValueError("text looks wrongly decoded")
    if pages and sum(len(p.strip()) for p in pages) < 50 * len(pages):
        raise ValueError("hardly any text; scanned?")
    out = Parsed(repaired_title(title) or file_title(name))
    if date and (m := re.match(r"(?:D:)?([0-9]{4})-?([0-9]{2})-?([0-9]{2})", date)):
        out.date = "-".join(m.groups())
    letters = str.maketrans(LIGATURES)
    for n, p in enumerate(pages, 1):
        p = p.translate(letters)
        text = re.sub(r"(?<=[a-z])-\n(?=[a-z])", "", p).strip().encode()[:MOST_PART].decode("utf-8", "ignore")
        if text:
            out.chunks.append(Chunk(len(out.chunks), f"p.{n}", 2, text, trail([out.title, f"p.{n}"])))
    return out


PARSERS = {"md": markdown, "txt": plain, "docx": docx, "xlsx": xlsx, "pptx": pptx}
BINARY = frozenset({"docx", "xlsx", "pptx"})


def registry(enabled: tuple[str, ...] = ("md",)) -> dict:
    unknown = [e for e in enabled if e not in PARSERS]
    if unknown:
        raise ValueError(f"unknown parsers: {', '.join(unknown)}")
    return {e: PARSERS[e] for e in enabled}


def parse(raw: bytes, path: str, parsers: dict, exclude: tuple[str, ...] = ()) -> tuple[str | None, Parsed | None]:
    """(error, document)."""
    try:
        if len(raw) > MOST_BYTES:
            raise ValueError("too large")
        return None, parsers[path.rsplit(".", 1)[-1].lower()](raw, path, exclude)
    except Exception as e:
        return f"{type(e).__name__}: {e}"[:500], None


def to_json(p: Parsed) -> str:
    return json.dumps({"title": p.title, "date": p.date, "topic": p.topic, "depth": p.depth, "tags": p.tags, "chunks": [vars(c) for c in p.chunks]}, ensure_ascii=False)
