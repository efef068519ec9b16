"""Repair of conversations against a search over all edits, on odd rows and conversations of many segments."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from corpuskit.llm import turn_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = SCHEMA + ", copies int"
BLANK = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
KEPT = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
NAMES = {"u": "user", "a": "assistant"}


def best_repair(rows):
    """rows of (role, text, must be deleted, truncated): cost, audit, lines, from the last row back to the first."""
    ahead = {}
    for state in NEXT:
        ahead[state] = {"": (0, "", None), "a": (0, "", None), "u": (2, "I", ("assistant:", None)),
                        "s": (4, "II", ("user:", ("assistant:", None)))}[state]
    for role, text, must, short in reversed(rows):
        here = {}
        for state in NEXT:
            ways = [(3 + ahead[state][0], "D" + ahead[state][1], ahead[state][2])]
            for before, cost, start, lines in [("", 0, state, ()), ("I", 2, NEXT[state], (NAMES[NEXT[state]] + ":",))]:
                if not must and (start, role[:1]) in KEPT:
                    c, audit, rest = ahead[role[0]]
                    ways.append((cost + short + c, before + "K" + audit, (*lines, role + ":" + text, rest)))
                if not must:
                    c, audit, rest = ahead[NEXT[start]]
                    ways.append((cost + 2 + short + c, before + "R" + audit, (*lines, NAMES[NEXT[start]] + ":" + text, rest)))
            here[state] = min(ways, key=lambda w: w[:2])
        ahead = here
    cost, audit, linked = ahead[""]
    lines = []
    while linked:
        *some, linked = linked
        lines += some
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute(rows):
    """rows of (conv_id, turn, role, text, copies)."""
    out = []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for conv_id, group in groupby(rows, key=lambda r: r[0]):
        found = [r for r in group for _ in range(r[4])]
        found.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        turns = [r[1] for r in found if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, _, role, text, _ in found:
            end = text.rstrip(BLANK)
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else 3
            seen.add((role, text))
            judged.append((role, text, fault < 2, int(fault == 2)))
            if fault < 3:
                counts[fault] += 1
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        cost, audit, sha = best_repair(judged)
        out.append((conv_id, gaps, *counts, illegal, cost, audit, sha))
    return sorted(map(repr, out))


def damage(rows):
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv_id, turn)).encode()) % 20
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        yield conv_id, turn, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)


def answers(df):
    return sorted(repr(tuple(r)) for r in df.collect())


ROLES = ["user"] * 6 + ["assistant"] * 6 + ["system"] * 2 + ["tool", "", " ", "ü", "sys", "Anna", "a", None]
TEXTS = ["yes.", "no!", "why?  ", "cut", "cut \n", "", " \t", "\u00a0", "é", None, "x.y", "line\nline."]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for conv in [None, *range(400)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.5 else rng.choice(ROLES)
            text = f"t{rng.random()}." if rng.random() < 0.6 else rng.choice(TEXTS)
            out.append((conv, rng.choice([turn, turn, turn, turn * 2, None, 0]), role, text))
    out += rng.choices(out, k=60)
    return [*out, (900, 1, "user", "y" * 3_000_000 + "."), (900, 2, "assistant", "z. " * 700_000)]


def test_random_conversations(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns(
        {n: F.lit("extra") for n in ("copies", "seg", "segment", "marks", "audit", "cost", "sha", "is_row", "n", "blank")})
    assert answers(repair.repair_conversations(repair.damaged(df))) == brute(damage(rows))


def test_long_conversations_in_segments(spark):
    """Three long ones, one of them mostly copies of a row, cut into segments and ranges."""
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), f"{t}" + rng.choice("..,"), 1)
            for c in (1, 2) for t in range(1500)]
    rows += [(3, 5, "user", "same.", 900), (3, 4, "system", "s.", 1), (3, None, "tool", "t", 2), (3, 6, "assistant", "b.", 1)]
    rows += [(4, 0, "user", "dropped", 0), *((5, t, *(("user", " ") if t % 2 else ("assistant", f"{t}.")), 1) for t in range(600))]
    rows += [(6, t, "user", " ", 1) for t in range(700)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert answers(repair.repair_conversations(df)) == brute(rows)
    segments, best = repair.solved_segments(df)
    sizes = [len(r.marks) // 2 for r in segments.collect()]
    assert max(sizes) <= repair.SEGMENT and best.where("conv_id = 1").count() >= 6


@pytest.mark.parametrize("seed", range(5))
def test_search_is_exact(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 5, 8, 40, 256):
        marks = [(rng.choice("uuaas?"), rng.choice("x..t....")) for _ in range(n)]
        rows = [(r, "", f == "x", int(f == "t")) for r, f in marks]
        assert repair.search(marks, repair.START, (repair.START, repair.ASSISTANT), True) == best_repair(rows)[:2]


def test_bound_is_never_above_the_cost():
    rng = random.Random(1)
    for _ in range(300):
        marks = [(rng.choice("uas?"), rng.choice("xt..")) for _ in range(rng.randint(0, 9))]
        bound = repair.suffix_bounds(marks)[0]
        for state in (repair.SYSTEM, repair.USER, repair.ASSISTANT):
            found = [repair.search(marks, state, (x,), False) for x in repair.STATES]
            assert all(f is None or f[0] >= bound for f in found)


def test_nothing(spark):
    assert repair.repair_conversations(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:7".encode()) % 20 == 0)
    got = repair.repair_conversations(repair.damaged(spark.createDataFrame([(dropped, 7, "user", "x.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
