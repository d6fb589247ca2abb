"""Path globs and ignore patterns as regular expressions."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """* and ? match any characters, / included; **, [sets] and {a,b} as usual. Anchored at both ends."""
    out, k, depth = "", 0, 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            if glob[k : k + 2] == "*/":
                out, k = out + "(?:.*/)?", k + 2
            else:
                while glob[k : k + 1] == "*":
                    k += 1
                out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", k + 1)) > 0:
            body = glob[k:end]
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]"
            k = end + 1
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and k < len(glob):
            out += re.escape(glob[k])
            k += 1
        else:
            out += re.escape(c)
    if depth:
        raise ValueError(f"unclosed brace in glob: {glob}")
    return f"(?s)^{out}$"


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over lower-case paths, whether it takes back) of one line of an ignore file; None for blanks and comments."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    folder = line.endswith("/")
    body = line.strip("/") if not line.startswith("/") else line[1:].rstrip("/")
    anchored = "/" in body or line.startswith("/")
    out, k = "", 0
    body = body.lower()
    while k < len(body):
        if body[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
        elif body[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(body[k]), k + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", back
