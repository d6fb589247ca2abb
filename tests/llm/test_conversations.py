"""Structure repair of conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import reduce

import pytest

from quarry.llm import turn_matrix as tm
from quarry.llm.conversations import repair_conversations

ROWS = "conv_id long, turn long, role string, text string"
FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(kinds):
    """(cost, audit) by trying all states with a table of the best paths, an edit at a time."""
    best = {(0, 0): (0, "")}
    order = [(0, 0)]
    todo = {(0, 0)}
    while todo:
        i, s = min(todo, key=lambda x: (best[x][0], best[x][1]))
        todo.discard((i, s))
        cost, audit = best[i, s]
        moves = [((i, tm.STEPS[s][c]), 3, "I") for c in "ua" if c in tm.STEPS[s]]
        if i < len(kinds):
            role, fault = kinds[i]
            moves.append(((i + 1, s), 4, "D"))
            if fault != "x":
                more = 3 if fault == "t" else 0
                if role in tm.STEPS[s]:
                    moves.append(((i + 1, tm.STEPS[s][role]), more, "K"))
                moves += [((i + 1, tm.STEPS[s][c]), 3 + more, "R") for c in "ua" if c in tm.STEPS[s]]
        for to, more, letter in moves:
            new = cost + more, audit + letter
            if to not in best or new < best[to]:
                best[to] = new
                todo.add(to)
                order.append(to)
    return min(best[len(kinds), s] for s in tm.FINAL if (len(kinds), s) in best)


def brute(rows, damage):
    """The results by the rules themselves, a conversation at a time."""
    out, by = [], {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in by.items():
        live = []
        for turn, role, text in own:
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            live += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in live:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
            seen.add((role, text))
        kinds = [(r[:1] if r[:1] in ("s", "u", "a") else "?") + ("x" if f in "bd" else f) for (_, r, _), f in zip(live, faults)]
        cost, audit = cheapest(kinds)
        lines, state, at = [], 0, 0
        for letter in audit:
            fill = "assistant" if state == 2 else "user"
            if letter == "I":
                lines.append(f"{fill}:")
                state = tm.STEPS[state][fill[0]]
                continue
            _, role, text = live[at]
            at += 1
            if letter != "D":
                role = role if letter == "K" else fill
                lines.append(f"{role}:{text}")
                state = tm.STEPS[state][role[0]]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = [t for t, _, _ in live if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(live))
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def invented(n, seed):
    r = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for t in range(r.randint(1, 14)):
            turn = r.choice([t, t, t, t + r.randint(0, 3), None])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "Éa"])
            text = r.choice(["Fine.", "so\n", "What?  \n", "", " \t", None, "cut", " ", "end. ", "x" * 50 + "!"])
            rows.append((conv, turn, role, text))
    return rows


def test_matrices_equal_the_search():
    r = random.Random(3)
    for _ in range(300):
        kinds = [r.choice("sua?") + r.choice("--tx") for _ in range(r.randint(0, 9))]
        want = cheapest(kinds)
        assert tm.repaired(tuple(kinds)) == want
        at = sorted(r.sample(range(len(kinds) + 1), min(2, len(kinds))))
        parts = [kinds[a:b] for a, b in itertools.pairwise([0, *at, len(kinds)])]
        assert tm.ends(tm.apply(tm.CLOSED[0], reduce(tm.product, map(tm.matrix_of, parts)))) == want


@pytest.mark.parametrize("damage", [True, False])
@pytest.mark.parametrize("long_rows", [256, 3])
def test_equals_brute_force(spark, damage, long_rows):
    rows = invented(60, 7) + invented(3, 8)  # ids of the second part repeat those of the first
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], ROWS + ", cost int, `a.b` string").repartition(5)
    got = sorted((tuple(r[f] for f in FIELDS) for r in repair_conversations(frame, damage=damage, long_rows=long_rows).collect()), key=str)
    assert got == brute(rows, damage)


def test_one_long_conversation_across_partitions(spark):
    r = random.Random(1)
    rows = [(4, t, r.choice(["user", "assistant", "system"]), r.choice([f"Line {t}.", "again.", "cut", ""])) for t in range(3000)] + [(5, 0, "user", "Hi."), (6, 0, "user", "Long " * 200_000 + ".")]
    frame = spark.createDataFrame(rows, ROWS).repartition(6)
    got = sorted((tuple(x[f] for f in FIELDS) for x in repair_conversations(frame).collect()), key=str)
    assert got == brute(rows, False)


def test_dropped_and_empty(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    out = repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.")] * 400, ROWS), damage=True).collect()
    assert [tuple(r[f] for f in FIELDS) for r in out] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair_conversations(spark.createDataFrame([], ROWS), damage=True).count() == 0
