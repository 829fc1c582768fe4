import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from diagspark.llm import conversation as C

SCHEMA = "conv_id long, turn long, role string, text string, cost long, key string"
GOOD = re.compile("(s?(ua)+)?")
LETTER = {"D": 4, "I": 3, "K": 0, "R": 3}


def enumerated(codes):
    """Every sequence of edits with at most two insertions in a row, the cheapest and ASCII-least."""
    best = None

    def walk(i, cost, audit, initials, inserted):
        nonlocal best
        if best and cost > best[0] or not re.match("s?[ua]*$", initials) or "uu" in initials or "aa" in initials or re.match("s?a", initials):
            return
        if i == len(codes) and GOOD.fullmatch(initials):
            best = min(best, (cost, audit)) if best else (cost, audit)
        if inserted < 2:
            for role in "ua":
                walk(i, cost + 3, audit + "I", initials + role, inserted + 1)
        if i == len(codes):
            return
        extra = 3 if codes[i].isupper() else 0
        walk(i + 1, cost + 4, audit + "D", initials, 0)
        if codes[i] != "-":
            walk(i + 1, cost + extra, audit + "K", initials + codes[i].lower(), 0)
            for role in "ua":
                walk(i + 1, cost + 3 + extra, audit + "R", initials + role, 0)

    walk(0, 0, "", "", 0)
    return best


def spread(codes):
    """The same by a plain pass over (state, cheapest) tables, for longer rows."""
    front = {0: (0, "")}
    close = lambda f: [f.__setitem__(C.TURN[s], min(f.get(C.TURN[s], (1 << 60, "")), (c + 3, a + "I"))) for _ in range(3) for s, (c, a) in list(f.items())]
    close(front)
    for row in codes:
        ahead = {}
        for state, (cost, audit) in front.items():
            for letter, paid, to in C.EDITS[row][state]:
                ahead[to] = min(ahead.get(to, (1 << 60, "")), (cost + paid, audit + letter))
        close(ahead)
        front = ahead
    return min(front[s] for s in (0, 3) if s in front)


@pytest.mark.parametrize("n", range(4))
def test_search_equals_enumeration_of_all_short_rows(n):
    for codes in map("".join, itertools.product("-suaxSUAX", repeat=n)):
        assert C.search(codes, 0, (0, 3)) == enumerated(codes), codes


def test_search_equals_enumeration_of_random_rows():
    rng = random.Random(5)
    for _ in range(60):
        codes = "".join(rng.choice("-suaUAx") for _ in range(rng.randint(4, 6)))
        assert C.search(codes, 0, (0, 3)) == enumerated(codes), codes


def test_search_of_long_rows_is_optimal():
    rng = random.Random(6)
    for weights in ("ua", "-suaxSUAX", "uuuua-", "a", "s", "X", "uA"):
        codes = "".join(rng.choice(weights) for _ in range(700))
        assert C.search(codes, 0, (0, 3)) == spread(codes)


def test_segments_join_to_the_whole():
    rng = random.Random(7)
    for _ in range(40):
        codes = "".join(rng.choice("-suaxSUAX") for _ in range(rng.randint(2, 40)))
        cut = rng.randint(1, len(codes) - 1)
        left, right = C.table(codes[:cut]), C.table(codes[cut:])
        ways = [(c + d, x + y) for (a, b), (c, x) in left.items() if a == 0 for (e, f), (d, y) in right.items() if e == b and f in (0, 3)]
        assert min(ways) == C.search(codes, 0, (0, 3))


def brute(rows):
    """The contract, conversation by conversation."""
    white, by = " \t\n\x0b\x0c\r", defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        hit = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        by[conv]
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            by[conv] += [(turn is not None, turn or 0, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, lines in by.items():
        lines.sort()
        seen, faults, codes = set(), [0, 0, 0], ""
        for _, _, role, text in lines:
            kept = text.rstrip(white)
            fault = 0 if not kept else 1 if (role, text) in seen else 2 if kept[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault < 2 else initial.upper() if fault == 2 else initial
        cost, audit = spread(codes)
        turns = {t for known, t, _, _ in lines if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[2][:1], b[2][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in itertools.pairwise(lines))
        at, said = 0, []
        length = sum(a != "D" for a in audit)
        names = (["system"] if length % 2 else []) + ["user", "assistant"] * (length // 2)
        for a in audit:
            if a == "D":
                at += 1
            elif a == "I":
                said.append(names[len(said)] + ":")
            else:
                said.append((lines[at][2] if a == "K" else names[len(said)]) + ":" + lines[at][3])
                at += 1
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def awkward():
    rng = random.Random(8)
    texts = ["Yes.", "No", "", None, " \n", "What? ", "é ü!", "Is it so?", "x" * 3000 + ".", "a:b\nc."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "Hello."), (None, None, "assistant", "Hi."), (None, None, "assistant", "Hi."), (70, None, None, None), (71, 5, "user", "A."), (71, 5, "user", "B."), (71, 9, "assistant", "A."), (71, 5, "user", "A.")]
    rows += [(72, t % 40, "user" if t % 2 else "assistant", f"Line {t % 50}.") for t in range(300)]
    rows += [(73, None, "user", "Same.") for _ in range(90)]
    return rows


@pytest.mark.parametrize("long", [4096, 7])
def test_awkward_rows(spark, long):
    rows = awkward()
    frame = spark.createDataFrame([(*r, 9, "clash") for r in rows], SCHEMA).repartition(3)
    got = C.repaired_conversations(frame, long)
    assert got.columns == ["conv_id", *(c.split()[0] for c in C.RESULT.split(", "))]
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == brute(rows)


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = C.repaired_conversations(frame).collect()
    want = brute([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == len(want) and {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_empty_table(spark):
    assert C.repaired_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
