"""Conversation structure repair by depth-first branch and bound.

A conversation's rows are edited at least cost until its role initials read
``(s?(ua)+)?``. The search keeps an explicit stack of prefixes. A prefix goes
if its cost and the suffix's lower bound pass the incumbent, or if its node
(row, state) was reached before as cheaply. Children are taken in the order of
their letters, so prefixes come to a node in ASCII order: of equally cheap ones
the first is the least, and a node is opened again only for a lower cost.

Conversations of up to ``LONG`` rows are one search each. Longer ones are cut
into segments in all partitions at once: a segment is searched from each entry
state to each exit state, and the tables of segments are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: Rows up to which a conversation is one search, and rows of a segment of a longer one.
LONG = 4096
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after s, after u, after a. What follows each by role initial.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The one turn (user or assistant) that an insertion or a new role can give after each state.
TURN = (USER, USER, ASSISTANT, USER)
#: The states from which each state can be reached.
BEFORE = ({START}, {START, SYSTEM}, {START, SYSTEM, USER, ASSISTANT}, {START, SYSTEM, USER, ASSISTANT})
NAMES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
WHITE = " \t\n\x0b\x0c\r"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def code(initial: str, must_go: bool, truncated: bool) -> str:
    """A row as the search sees it: '-' has to be deleted; else its initial (x: none of s, u, a), in capitals if truncated."""
    if must_go:
        return "-"
    kept = initial if initial in ("s", "u", "a") else "x"
    return kept.upper() if truncated else kept


def _edits(row: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, in ASCII order."""
    out = [("D", DELETE, state)]
    if row != "-":
        extra = TRUNCATED if row.isupper() else 0
        if (kept := NEXT[state].get(row.lower())) is not None:
            out.append(("K", extra, kept))
        out.append(("R", REROLE + extra, TURN[state]))
    return out


EDITS = {row: tuple(tuple(_edits(row, state)) for state in range(4)) for row in "-suaxSUAX"}


def bounds(rows: str) -> list[tuple[int, int, int, int]]:
    """By row and state, a lower bound of what the rest costs: the end may lie in any state."""
    below = (0, 0, 0, 0)
    out = [below]
    for row in reversed(rows):
        least = [min(cost + below[to] for _, cost, to in EDITS[row][state]) for state in range(4)]
        for _ in range(2):  # insertions: at most two of them lead to any state that can be reached
            least = [min(x, INSERT + least[TURN[state]]) for state, x in enumerate(least)]
        below = tuple(least)
        out.append(below)
    return out[::-1]


def _dive(rows: str, entry: int, exits: tuple[int, ...], bound: list) -> tuple[int, str] | None:
    """A first incumbent: the edits that the bounds favour, then insertions up to an exit."""
    state, cost, audit = entry, 0, []
    for i, row in enumerate(rows):
        steps = [(c + bound[i + 1][to], a, c, to) for a, c, to in EDITS[row][state]]
        turn = TURN[state]
        steps += [(INSERT + c + bound[i + 1][to], "I" + a, INSERT + c, to) for a, c, to in EDITS[row][turn]]
        _, letters, paid, state = min(steps)
        cost += paid
        audit.append(letters)
    for _ in range(3):
        if state in exits:
            return cost, "".join(audit)
        state, cost = TURN[state], cost + INSERT
        audit.append("I")
    return None


def search(rows: str, entry: int, exits: tuple[int, ...], bound: list | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from ``entry`` to one of ``exits``, of equal ones the ASCII-least; None if there are none."""
    bound = bound or bounds(rows)
    n = len(rows)
    first = _dive(rows, entry, exits, bound)
    limit = first[0] if first else INSERT * 2 + DELETE * n
    useful = set().union(*(BEFORE[s] for s in exits))
    incumbent: tuple[int, object] | None = None
    seen: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, int, int, object]] = [(0, entry, 0, None)]  # row, state, cost, letters as (before, letter)
    while stack:
        i, state, cost, letters = stack.pop()
        if state not in useful or cost + bound[i][state] > limit or seen.get((i, state), limit + 1) <= cost:
            continue
        seen[i, state] = cost
        if i == n and state in exits:
            incumbent, limit = (cost, letters), cost - 1  # from now on only what is cheaper counts
            continue
        children = [("I", INSERT, TURN[state], i)]
        if i < n:
            children = sorted(children + [(a, c, to, i + 1) for a, c, to in EDITS[rows[i]][state]])
        for a, c, to, at in reversed(children):
            stack.append((at, to, cost + c, (letters, a)))
    if incumbent is None:
        return None
    cost, letters = incumbent
    audit = []
    while letters:
        letters, a = letters
        audit.append(a)
    return cost, "".join(reversed(audit))


@lru_cache(1 << 13)
def repair(rows: str) -> tuple[int, str]:
    """The cheapest repair of a whole conversation."""
    return search(rows, START, ACCEPTED)


def table(rows: str) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest edits of a segment from each entry to each exit state."""
    bound = bounds(rows)
    found = {(a, b): search(rows, a, (b,), bound) for a in range(4) for b in range(4)}
    return {pair: best for pair, best in found.items() if best}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: the rows after damage; a dropped one stays with a null text so that its conversation is not lost."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20).alias("damage"))
    hit = F.col("damage")
    changed = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).when(hit != 0, F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    copies = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(copies).alias("copy"))


def _marks(text: str) -> tuple[Column, Column]:
    """blank, truncated."""
    kept = F.rtrim(F.col(text), F.lit(WHITE))
    return kept == "", ~F.substring(kept, -1, 1).isin(".", "!", "?")


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], columns: tuple[str, ...], most: int | None = None) -> Iterator[tuple[tuple, list[list], int]]:
    """Runs of rows with an equal key in sorted batches, as lists by column; a run of over ``most`` rows comes in numbered parts."""
    last, held, part = None, [[] for _ in columns], 0
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
        values = [batch.column(c).to_pylist() for c in columns]
        at = 0
        while at < len(keys):
            if keys[at] != last:
                if held[0]:
                    yield last, held, part
                last, held, part = keys[at], [[] for _ in columns], 0
            end, room = at + 1, most - len(held[0]) if most else len(keys)
            while end < len(keys) and end - at < room and keys[end] == last:
                end += 1
            for h, v in zip(held, values, strict=True):
                h.extend(v[at:end])
            at = end
            if len(held[0]) == most:
                yield last, held, part
                held, part = [[] for _ in columns], part + 1
    if held[0]:
        yield last, held, part


def _repaired(audit: str, roles: list[str], texts: list[str], state: int = START) -> Iterator[str]:
    """``role:text`` of each row after the edits; ``roles`` and ``texts`` are those of the rows before them."""
    at = 0
    for a in audit:
        if a == "I":
            state = TURN[state]
            yield f"{NAMES[state]}:"
            continue
        if a == "R":
            state = TURN[state]
            yield f"{NAMES[state]}:{texts[at]}"
        elif a == "K":
            state = NEXT[state][roles[at][:1]]
            yield f"{roles[at]}:{texts[at]}"
        at += 1


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _short(rows: DataFrame) -> DataFrame:
    """The result of conversations that fit a search each: one exchange, by conversation."""
    blank, cut = _marks("text")
    ready = rows.select("key", "conv_id", "turn", "role", "text", blank.alias("blank"), cut.alias("cut"), "copy").repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text", "copy")
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kind = None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", *(c.split()[0] for c in RESULT.split(", "))])

        for _, (ids, turns, roles, texts, blanks, cuts), _ in _groups(watched(), ("key",), ("conv_id", "turn", "role", "text", "blank", "cut")):
            live = [i for i, t in enumerate(texts) if t is not None]
            roles, texts = [roles[i] for i in live], [texts[i] for i in live]
            seen: set[tuple[str, str]] = set()
            faults, codes = [0, 0, 0], []
            for i, role, text in zip(live, roles, texts, strict=True):
                fault = 0 if blanks[i] else 1 if (role, text) in seen else 2 if cuts[i] else 3
                seen.add((role, text))
                if fault < 3:
                    faults[fault] += 1
                codes.append(code(role[:1], fault < 2, fault == 2))
            cost, audit = repair("".join(codes))
            digest = hashlib.sha256("\n".join(_repaired(audit, roles, texts)).encode()).hexdigest()
            out.append((ids[0], _gaps([turns[i] for i in live]), *faults, _illegal([r[:1] for r in roles]), cost, audit, digest))
            if len(out) == 4096:
                yield flushed()
                out = []
        if out:
            yield flushed()

    return ready.mapInArrow(solved, f"conv_id {id_type}, {RESULT}")


_SUMMARY = "key string, part long, first string, last string, low long, high long, low_turn boolean, distinct long, blank long, duplicate long, cut long, illegal long, entries array<int>, exits array<int>, costs array<long>, audits array<string>"


def _long(rows: DataFrame, most: int) -> DataFrame:
    """The result of longer conversations: rows lie in ranges of (conversation, turn), so that one conversation takes many tasks."""
    counted = rows.where("text is not null").groupBy("key", "turn", "role", "text").agg(F.count("*").alias("copies"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    marked = counted.select("*", digest.alias("digest"), F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at"))
    first = marked.groupBy("key", "role", "digest").agg(F.min("at").alias("first"))
    blank, cut = _marks("text")
    known = marked.join(first, ["key", "role", "digest"]).select("key", "turn", "role", "text", blank.alias("blank"), cut.alias("cut"), (F.col("at") > F.col("first")).alias("again"), "copies")
    order = ["key", F.asc_nulls_first("turn"), "role", "text"]
    # Equal rows are one row with a count, so a range never ends inside them; the written table fixes the ranges.
    ranged = known.repartitionByRange(*order).withColumn("range", F.spark_partition_id().cast("long"))
    each = F.explode(F.when(F.col("copies") > 1, F.expr("sequence(0L, copies - 1)")).otherwise(F.array(F.lit(0).cast("long")))).alias("copy")
    placed = stored(ranged.sortWithinPartitions(*order), "conversation-rows")
    lined = placed.select("key", "turn", "role", "text", "blank", "cut", "again", "range", each).repartition("key", "range").sortWithinPartitions("key", "range", *order[1:], "copy")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (key, range_), columns, part in _groups(batches, ("key", "range"), ("turn", "role", "text", "blank", "cut", "again", "copy"), most):
            yield key, range_ << 32 | part, columns

    def codes_of(columns: list[list]) -> tuple[list[int], str]:
        _, roles, _, blanks, cuts, again, copies = columns
        faults = [0 if b else 1 if a or c else 2 if t else 3 for b, a, c, t in zip(blanks, again, copies, cuts, strict=True)]
        return faults, "".join(code(r[:1], f < 2, f == 2) for r, f in zip(roles, faults, strict=True))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, columns in parts(batches):
            faults, codes = codes_of(columns)
            known = {t for t in columns[0] if t is not None}
            initials = [r[:1] for r in columns[1]]
            cells = sorted(table(codes).items())
            row = {"key": key, "part": part, "first": initials[0], "last": initials[-1], "low": min(known, default=None), "high": max(known, default=None), "low_turn": bool(known), "distinct": len(known), "blank": faults.count(0), "duplicate": faults.count(1), "cut": faults.count(2), "illegal": _illegal(initials)}
            row |= {"entries": [a for (a, _), _ in cells], "exits": [b for (_, b), _ in cells], "costs": [c for _, (c, _) in cells], "audits": [x for _, (_, x) in cells]}
            kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array([row[n]], kinds[k]) for n, k in (c.split() for c in _SUMMARY.split(", "))], list(row))

    tables = stored(lined.mapInArrow(summed, _SUMMARY), "conversation-tables").repartition("key").sortWithinPartitions("key", "part")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each conversation: its counts, and each segment's edits and entry state on the cheapest way through all of them."""
        names = tuple(c.split()[0] for c in _SUMMARY.split(", "))[1:]
        for (key,), columns, _ in _groups(batches, ("key",), names):
            rows = [dict(zip(names, r, strict=True)) for r in zip(*columns, strict=True)]
            front: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}
            for r in rows:
                ahead: dict[int, tuple[int, str, tuple]] = {}
                for a, b, c, x in zip(r["entries"], r["exits"], r["costs"], r["audits"], strict=True):
                    if a in front:
                        cost, audit, way = front[a]
                        if b not in ahead or (cost + c, audit + x) < ahead[b][:2]:
                            ahead[b] = cost + c, audit + x, (way, a, x)
                front = ahead
            cost, audit, way = min(front[s] for s in ACCEPTED if s in front)
            steps = []
            while way:
                way, a, x = way
                steps.append((a, x))
            steps.reverse()
            # A turn's rows may lie on both sides of a cut.
            shared = sum(p["high"] is not None and p["high"] == q["low"] for p, q in zip(rows, rows[1:], strict=False))
            low, high = [r["low"] for r in rows if r["low_turn"]], [r["high"] for r in rows if r["low_turn"]]
            gaps = max(high) - min(low) + 1 - (sum(r["distinct"] for r in rows) - shared) if low else 0
            illegal = sum(r["illegal"] for r in rows) + sum(_illegal([p["last"], q["first"]]) for p, q in zip(rows, rows[1:], strict=False))
            counts = [gaps, *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "cut")), illegal, cost]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * n), pa.array([r["part"] for r in rows], pa.int64()), pa.array([a for a, _ in steps], pa.int32()), pa.array([x for _, x in steps], pa.string()), *(pa.array([c] + [None] * (n - 1), pa.int64()) for c in counts)],
                ["key", "part", "entry", "edits", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"],
            )

    ways = stored(tables.mapInArrow(joined, "key string, part long, entry int, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"), "conversation-ways")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, columns in parts(batches):
            # The edits are chosen later; a segment's rows go on as they are, in one piece.
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int64()), pa.array([columns[1]], pa.list_(pa.string())), pa.array([columns[2]], pa.list_(pa.string()))], ["key", "part", "roles", "texts"])

    pieces = lined.mapInArrow(edited, "key string, part long, roles array<string>, texts array<string>")
    whole = pieces.join(ways.select("key", "part", "entry", "edits"), ["key", "part"]).repartition("key").sortWithinPartitions("key", "part")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """SHA-256 of a conversation runs through its segments in order; one segment is held at a time."""
        last, digest, audit, began = None, hashlib.sha256(), [], False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["key", "audit", "repaired_sha256"])

        for batch in batches:
            for key, entry, edits, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("key", "entry", "edits", "roles", "texts")), strict=True):
                if key != last:
                    if last is not None:
                        yield done()
                    last, digest, audit, began = key, hashlib.sha256(), [], False
                audit.append(edits)
                for line in _repaired(edits, roles, texts, entry):
                    digest.update((b"\n" if began else b"") + line.encode())
                    began = True
        if last is not None:
            yield done()

    ends = whole.mapInArrow(hashed, "key string, audit string, repaired_sha256 string")
    ids = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    return ids.join(ways.where("cost is not null"), "key", "left").join(ends, "key", "left").select("conv_id", *(F.coalesce(c, F.lit(none[c]).cast(k)).alias(c) for c, k in (x.split() for x in RESULT.split(", "))))


def repaired_conversations(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: each conversation's faults after damage and its cheapest repair.

    A null role or text is one space, as are null ids and turns where the
    damage is drawn; rows without an id are one conversation. Rows lie by turn,
    nulls first; those of one turn by role and text (of code points). Repeated
    rows are duplicates. A conversation without a row after damage, or one
    whose rows all go, has an empty audit and the hash of the empty string; an
    empty table gives no rows. Columns beside the four are ignored.

    Conversations of over ``long`` rows are cut into segments that are searched
    in many tasks. Their SHA-256 has to run through one task, a segment at a
    time; the audit is one string, as long as the conversation has rows.
    """
    rows = damaged(conversations).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    longer = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > long).select("key")
    longer = stored(longer, "long-conversations")
    short = _short(rows.join(longer, "key", "left_anti"))
    if longer.isEmpty():
        return short
    return short.unionByName(_long(rows.join(longer, "key", "left_semi"), long))
