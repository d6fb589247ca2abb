"""Byte spans of query terms in a text."""

from __future__ import annotations

from quarry.functions.query_compiler import phrases

MOST_BYTES, MOST_TERMS = 256 * 1024, 100


def match_spans(query: str, content: str | None) -> list[tuple[int, int]] | None:
    """Merged (start, end) bytes where terms occur, ignoring ASCII case. None, not computed: a term that is not ASCII, or a content over 256 KiB."""
    terms = phrases(query) or query.split()
    raw = (content or "").encode()
    if any(not t.isascii() for t in terms) or len(raw) > MOST_BYTES:
        return None
    terms = sorted({t.lower() for t in terms if t})[:MOST_TERMS]
    low = raw.lower()  # of bytes: ASCII letters only
    found: list[tuple[int, int]] = []
    for t in terms:
        budget, at, needle = max(1, MOST_TERMS // len(terms)), 0, t.encode()
        while budget and (at := low.find(needle, at)) >= 0:
            found.append((at, at + len(needle)))
            at += len(needle)
            budget -= 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
