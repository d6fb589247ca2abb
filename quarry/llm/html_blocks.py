"""Leaf blocks of HTML pages, with their tag paths (no Spark). Reading is linear in the length of a page."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Where markup may begin; any other < is text.
_OPEN = re.compile(r"<(?=[A-Za-z!?/])")
#: A start or end tag: the name, then attributes. Quotes count only around a value; an unclosed one is part of an unquoted value.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|(?:=|[^\s/>=])[^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+)*+)>")
#: A tag whose quotes lead to the page's end ends at the first >.
_CUT_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
#: Failed attempts at _TAG after which a page's tags are read by _CUT_TAG alone.
_PATIENCE = 8
#: Text up to the end tag is no markup and no text of the page. Without an end tag the first two run to the end of the page, of others only the tag is skipped.
_RAW = frozenset("script style iframe noembed noframes textarea title xmp".split())
_TO_THE_END = frozenset(("script", "style"))
#: Elements whose content isn't text of the page. One without an end tag is skipped as a tag alone.
_SKIPPED = frozenset("annotation annotation-xml audio button canvas datalist noscript select svg template video".split())
#: A second one ends the first.
_SINGLE = frozenset("audio button canvas datalist noscript select video".split())
_IN_HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
_NAMED = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z]+|[0-9]+")
#: Elements that are part of a line of text; all others part blocks.
_INLINE = frozenset(
    (
        "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr object output picture q rb rp rt rtc ruby s samp slot small span strike strong sub sup time tt u var wbr input "
        "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
    ).split()
)
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Opening one of these ends an open one of the same kind.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}
#: Opening a block of this kind ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SCOPE = frozenset("article aside div footer form header main nav section table td th ul ol body html".split())
#: Open elements, from the innermost, that a block's path tells of.
_DEPTH = 48


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: float  # share of the characters inside links


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"<{tag}>"]
    if "=" in attributes:
        for m in _NAMED.finditer(attributes):
            out += [p.lower() for p in _PART.findall(m[1] or m[2] or m[3] or "")]
    return tuple(out)


def _ends_of(page: str, tag: str) -> dict[int, int]:
    """Of every element of a kind: where its start tag ends, to where it ends. Elements that are never closed are left out."""
    out, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}(?![\w:-])[^>]*+(>|\Z)", page, re.IGNORECASE):
        if m[1]:
            if opened:
                out[opened.pop()] = m.end()
        elif not m[0].endswith("/>"):
            if tag in _SINGLE:
                opened.clear()
            opened.append(m.end())
    return out


class _Reader:
    def __init__(self, page: str):
        self.page = page
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.opened: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.links = 0
        self.path: tuple[str, ...] = ()
        self.in_head = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.path, min(1.0, self.links / len(text))))
            self.parts.clear()
        self.links = 0

    def add(self, raw: str) -> None:
        if self.in_head:
            if not raw.strip():
                return
            self.in_head = False
        if raw:
            if not self.parts:
                self.path = tuple(t for tag, tokens in self.stack[-_DEPTH:] if tag not in _INLINE for t in tokens)
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.opened["a"]:
                self.links += len(text)

    def close(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        if any(tag not in _INLINE for tag, _ in self.stack[k:]):
            self.flush()
        for tag, _ in self.stack[k:]:
            self.opened[tag] -= 1
        del self.stack[k:]

    def end(self, tag: str) -> None:
        if tag == "head":
            self.in_head = False
        if not self.opened[tag]:
            if tag not in _INLINE:
                self.flush()
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.close(k)
                return
            if self.stack[k][0] in _SCOPE and (tag in _INLINE or tag in ("p", "li")):
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag == "head":
            self.in_head = True
            return
        if self.in_head and tag not in _IN_HEAD:
            self.in_head = False
        if tag == "br":
            if self.parts:
                self.parts.append(" ")
            return
        if tag not in _INLINE:
            self.flush()
        ends = _ENDS.get(tag, frozenset()) | ({"p"} if tag in _ENDS_P else frozenset())
        if any(self.opened[t] for t in ends):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in ends:
                    self.close(k)
                    break
                if self.stack[k][0] in _SCOPE:
                    break
        if tag not in _VOID and not attributes.endswith("/"):
            self.stack.append((tag, _tokens(tag, attributes)))
            self.opened[tag] += 1

    def read(self) -> list[Block]:
        page, at, failed = self.page, 0, 0
        ends: dict[str, dict[int, int]] = {}
        closed: dict[str, bool] = {}
        last = page.rfind(">")
        while m := _OPEN.search(page, at):
            spot = m.start()
            self.add(page[at:spot])
            if page.startswith("<!--", spot):
                at = _after_comment(page, spot)
                continue
            if spot > last:  # a tag that never ends is no text
                at = len(page)
                break
            tag = _TAG.match(page, spot) if failed < _PATIENCE else _CUT_TAG.match(page, spot)
            if tag is None and page[spot + 1] not in "!?":
                failed += 1
                tag = _CUT_TAG.match(page, spot)
            if tag is None:  # declarations and the like
                at = page.index(">", spot) + 1
                continue
            at, name = tag.end(), tag[2].lower()
            if tag[1]:
                self.end(name)
            elif name in _RAW:
                self.in_head = self.in_head and name in _IN_HEAD
                if closed.get(name, True):
                    found = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(page, at)
                    closed[name] = found is not None
                    if found:
                        at = found.end()
                if not closed[name] and name == "title":
                    at = page.find("<", at) % (len(page) + 1)
                elif not closed[name] and name in _TO_THE_END:
                    at = len(page)
            elif name in _SKIPPED and not tag[3].endswith("/"):
                self.in_head = self.in_head and name in _IN_HEAD
                if name not in ends:
                    ends[name] = _ends_of(page, name)
                at = ends[name].get(at, at)
            else:
                self.start(name, tag[3])
        self.add(page[at:])
        self.flush()
        return self.blocks


def _after_comment(page: str, at: int) -> int:
    """Where a comment ends: at --> or --!>, or at once if it is <!--> or <!--->; without an end at the end of the page."""
    for short in ("<!-->", "<!--->"):
        if page.startswith(short, at):
            return at + len(short)
    m = re.compile(r"--!?>").search(page, at + 4)
    return m.end() if m else len(page)


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of text in page order, white space as single spaces, character references decoded; scripts, styles and the like are no text."""
    return _Reader(page or "").read()
