"""Text and path functions, as Column expressions wherever Spark has the pieces and as plain Python where a driver needs them too."""

from __future__ import annotations

import datetime
import unicodedata
from functools import lru_cache
from urllib.parse import quote, unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that are a placeholder when they make up a whole chunk.
BOILERPLATE = ("TBD", "TODO", "WIP", "N/A", "未定", "準備中", "(準備中)", "詳細は後述", "詳細は後述する", "ここに書く", "後で書く", "Coming soon", "後述")


@lru_cache(maxsize=1)
def latin_folds() -> tuple[str, str]:
    """Letters of one base and one diacritic below U+0250, and their bases."""
    marked, bases = [], []
    for point in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) == 2 and unicodedata.combining(parts[1]):
            marked.append(chr(point))
            bases.append(parts[0])
    return "".join(marked), "".join(bases)


def fold(text: Column) -> Column:
    """Case fold and removal of single diacritics, as trigram search compares."""
    plain = F.octet_length(text) == F.char_length(text)  # ASCII has nothing to translate, which costs more than all else
    return F.lower(F.when(plain, text).otherwise(F.translate(text, *latin_folds())))


@lru_cache(maxsize=1)
def _folds() -> dict[int, int]:
    return str.maketrans(*latin_folds())


def fold_text(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_folds()).lower()


def normalize_heading(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def normalize_quote(text: Column) -> Column:
    """Lower case, any Unicode white space as one blank, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def snippet(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("int")


#: What may stand behind a placeholder.
_TAIL = ".。、, \t"


def is_boilerplate(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(text), f"[{_TAIL}]+$", "")
    # the pattern is tried at each place of a text, so only where the two characters behind the longest placeholder's length may be left out
    short = F.btrim(F.substring(F.trim(text), max(map(len, BOILERPLATE)) + 1, 2), F.lit(_TAIL)) == ""
    return short & F.upper(bare).isin([b.upper() for b in BOILERPLATE])


def quality_score(content: Column, binary: Column | None = None) -> Column:
    """1.0 less 0.6 under 30 characters, 0.5 for a placeholder, 0.3 without line break under 80 characters; not below 0. Binary sources are exempt from both lengths."""
    size = F.length(F.trim(content))
    plain = F.lit(True) if binary is None else ~binary
    score = F.lit(1.0) - F.when(plain & (size < 30), 0.6).otherwise(0.0) - F.when(is_boilerplate(content), 0.5).otherwise(0.0)
    score = score - F.when(plain & (size < 80) & ~F.contains(F.trim(content), F.lit("\n")), 0.3).otherwise(0.0)
    return F.round(F.greatest(score, F.lit(0.0)), 6)


def breadcrumb(parts: Column, size: int = 200) -> Column:
    """Trimmed non-empty parts without consecutive repeats, joined by ' > ', at most `size` characters; null when nothing is left."""
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    kept = F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1)))
    return F.when(F.size(kept) > 0, F.substring(F.array_join(kept, " > "), 1, size))


def embedding_text(context: Column, content: Column) -> Column:
    return F.when(F.coalesce(F.trim(context), F.lit("")) != "", F.concat(context, F.lit("\n\n"), content)).otherwise(content)


def category_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(0)))


def topic_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1)))


def group_prefix(path: Column) -> Column:
    """The first two directories at most."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(2))), "/")


def title_from_path(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(stem, "[-_]", " "), r"(?U)\s+", " "))


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def heading_level(line: Column) -> Column:
    marks = F.regexp_extract(F.trim(line), r"^(#{2,3}) ", 1)
    return F.when(F.length(marks) > 0, F.length(marks))


def heading_text(line: Column) -> Column:
    return F.when(heading_level(line).isNotNull(), F.trim(F.regexp_extract(F.trim(line), r"^#{2,3} (.*)$", 1)))


def iso_date(text: Column) -> Column:
    """D:YYYYMMDD… and YYYY-MM-DD… as YYYY-MM-DD, else null."""
    pdf = F.regexp_extract(text, r"^(?:D:)?([0-9]{4})([0-9]{2})([0-9]{2})", 1)
    joined = F.concat_ws("-", *(F.regexp_extract(text, r"^(?:D:)?([0-9]{4})([0-9]{2})([0-9]{2})", k) for k in (1, 2, 3)))
    iso = F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.when(iso != "", iso).when(pdf != "", joined)


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[a-z])-\n(?=[a-z])", "")


# Presentation ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}


def expand_ligatures(text: Column) -> Column:
    for mark, letters in LIGATURES.items():
        text = F.replace(text, F.lit(mark), F.lit(letters))
    return text


def parse_tags(text: Column) -> Column:
    """A JSON array of strings; malformed text and null give an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def tags_malformed(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).isin("") == F.lit(False)


def encode_path(path: str) -> str:
    return quote(path, safe="/")


def parse_uri(uri: str, scheme: str = "kb") -> tuple[str, str] | None:
    """(kind, path) of scheme://doc/… and scheme://topic/…; null for others, malformed escapes and paths that leave the root."""
    for kind in ("doc", "topic"):
        head = f"{scheme}://{kind}/"
        if uri.startswith(head):
            rest = uri[len(head) :]
            if any(len(p) < 2 or any(c not in "0123456789abcdefABCDEF" for c in p[:2]) for p in rest.split("%")[1:]):
                return None
            try:
                path = unquote_to_bytes(rest).decode("utf-8")
            except UnicodeDecodeError:
                return None
            bad = not path or path.startswith("/") or "\\" in path or "\0" in path or any(p in ("", ".", "..") for p in path.split("/"))
            return None if bad else (kind, path)
    return None


def section(text: str, target: str) -> str | None:
    """The first '## ' section whose heading contains target, whatever the case, up to the next one."""
    out: list[str] | None = None
    for line in text.split("\n"):
        if line.startswith("## "):
            if out is not None:
                break
            if target.lower() in line[3:].lower():
                out = [line]
                continue
        if out is not None:
            out.append(line)
    return None if out is None else "\n".join(out).rstrip()


def days_before(day: str, days: int) -> str:
    """The ISO date so many days before one."""
    return (datetime.date.fromisoformat(day) - datetime.timedelta(days=days)).isoformat()


def template_paths(templates: tuple[str, ...], target: str) -> list[str]:
    """The candidates that templates with {target} stand for, in their order; those that leave the root are no candidates."""
    paths = [t.replace("{target}", target) for t in templates]
    return [p for p in paths if not p.startswith("/") and "\\" not in p and "\0" not in p and not any(x in ("", ".", "..") for x in p.split("/"))]


# Estimated widths of characters in ems, and the headroom over them.
_EM = {"ijlItfr.,;:'!|()[]{}/\\-": 0.30, " ": 0.28, "WM@%mw": 0.90}
_HEADROOM = 1.15


def text_width(text: str, size: float) -> float:
    """The estimated width of a line at a font size; characters outside ASCII count as full width."""
    em = lambda c: next((w for cs, w in _EM.items() if c in cs), 1.0 if c > "\x7f" else 0.70 if c.isupper() else 0.55)
    return sum(map(em, text)) * size * _HEADROOM


def fit_width(text: str, size: float, width: float) -> str:
    """text, or its longest beginning that fits in the width with an ellipsis behind it."""
    if text_width(text, size) <= width:
        return text
    left = width - text_width("…", size)
    n = 0
    while n < len(text) and text_width(text[: n + 1], size) <= left:
        n += 1
    return text[:n] + "…"


def truncate_bytes(text: str, size: int) -> str:
    return text.encode()[:size].decode("utf-8", "ignore")
