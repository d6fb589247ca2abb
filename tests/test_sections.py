"""Sections by windows against a walk over the lines."""

import random

from quarry.operators.sections import sections


def walk(lines):
    import re

    stack, out, n, fenced = [], [], 0, False
    for line in lines:
        text = line or ""
        mark = re.match(r"[ ]{0,3}(```|~~~)", text)
        found = None if fenced or mark else re.match(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", text)
        fenced ^= bool(mark)
        if found:
            level, n = len(found[1]), n + 1
            stack = [x for x in stack if x[0] < level]
            out.append((level, found[2], n, [h for _, h in stack]))
            stack.append((level, found[2]))
        else:
            out.append((None, None, n, [h for _, h in stack]))
    return out


def test_equals_a_walk(spark):
    r = random.Random(1)
    docs = {d: [r.choice(["# A", "## B b ##", "### C", "###### F", "####### no", "#no", "text", None, "", "```", "~~~ x", "#\tT"]) for _ in range(r.randint(0, 40))] for d in range(30)}
    rows = [(d, k, x) for d, lines in docs.items() for k, x in enumerate(lines)]
    got = {(x["document_id"], x["pos"]): (x["level"], x["heading"], x["section"], x["ancestors"]) for x in sections(spark.createDataFrame(rows, "document_id long, pos int, line string").repartition(5)).collect()}
    assert got == {(d, k): w for d, lines in docs.items() for k, w in enumerate(walk(lines))}
