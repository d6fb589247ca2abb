"""From a query's text to the phrases of a trigram search."""

from __future__ import annotations

LEAST, MOST = 3, 32
# The characters of the scripts; all others are words if alphanumeric.
SCRIPTS = {
    "kanji": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F), (0x3005, 0x3005), (0x3006, 0x3006)),
    "hiragana": ((0x3041, 0x309F),),
    "katakana": ((0x30A1, 0x30FF), (0xFF66, 0xFF9F)),
}


def script(c: str) -> str:
    """kanji, hiragana, katakana, word or gap."""
    p = ord(c)
    for kind, ranges in SCRIPTS.items():
        if any(low <= p <= high for low, high in ranges):
            return kind
    return "word" if c.isalnum() or c in "_-" else "gap"


def quoted_parts(query: str) -> list[tuple[bool, str]]:
    """(quoted, text) segments; a doubled quote stands for one, an unclosed one makes the rest plain."""
    out, at = [], 0
    while (start := query.find('"', at)) >= 0:
        text, k = [], start + 1
        while k < len(query):
            if query[k] == '"':
                if query[k + 1 : k + 2] != '"':
                    break
                k += 1
            text.append(query[k])
            k += 1
        if k >= len(query):
            break
        if query[at:start]:
            out.append((False, query[at:start]))
        out.append((True, "".join(text)))
        at = k + 1
    if query[at:]:
        out.append((False, query[at:].replace('"', " ") if '"' in query[at:] else query[at:]))
    return out


def runs(text: str) -> list[list[str]]:
    """Groups parted by gaps, each as runs of one script."""
    groups: list[list[str]] = []
    last = "gap"
    for c in text:
        kind = script(c)
        if kind != "gap":
            if last == "gap":
                groups.append([c])
            elif kind == last:
                groups[-1][-1] += c
            else:
                groups[-1].append(c)
        last = kind
    return groups


def group_phrases(parts: list[str]) -> list[str]:
    """Runs of three characters or more are phrases. A shorter one takes following runs until it is long enough, and the last that it took is a
    phrase again if long enough by itself. A short rest lengthens the phrase before it, whose own form is kept behind; without one it is dropped."""
    out: list[str] = []
    k = 0
    while k < len(parts):
        phrase, taken = parts[k], parts[k]
        k += 1
        while len(phrase) < LEAST and k < len(parts):
            taken = parts[k]
            phrase += taken
            k += 1
        if len(phrase) >= LEAST:
            out.append(phrase)
            if taken != phrase and len(taken) >= LEAST:
                out.append(taken)
        elif out:
            before = out.pop()
            out += [before + phrase, before]
    return out


def phrases(query: str) -> list[str]:
    """At most 32 distinct phrases in order of their first place."""
    found: list[str] = []
    for quoted, text in quoted_parts(query):
        if quoted:
            found += [text] if len(text) >= LEAST and "\0" not in text else []
        else:
            for group in runs(text):
                found += group_phrases(group)
    return list(dict.fromkeys(found))[:MOST]


def compile_query(query: str) -> list[str]:
    """phrases(), or the whole trimmed query if there are none and it has three characters and no NUL; else empty: no text search."""
    out, whole = phrases(query), query.strip()
    return out or ([whole] if len(whole) >= LEAST and "\0" not in whole else [])


def match_expression(terms: list[str]) -> str:
    return " OR ".join('"' + t.replace('"', '""') + '"' for t in terms)
