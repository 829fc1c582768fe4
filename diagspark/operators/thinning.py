"""Greedy sampling of long series in many tasks.

Which rows are kept depends on the row kept last, so the walk is sequential.
It is cut into stretches of time: only the first rows of a stretch, up to one
span long, can be the first that is kept there, and each leads to a last
kept row. These pairs say what a stretch makes of any time that comes in;
joined in order they give each stretch its own, and then all walk apart.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A stretch is a day, or so many spans if that is longer.
SPANS = 64
_DAY = 86_400_000_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def outlets(times: Iterator[int], begin: int, span: int) -> list[tuple[int, int]]:
    """(first kept, last kept) of a stretch for each row that can be its first kept one; ``times`` ascend."""
    chains: deque[tuple[int, list[int]]] = deque()  # last kept, and the entries that lead there
    entries, newest = True, None
    for at in times:
        merged: list[int] = []
        while chains and chains[0][0] + span <= at:
            merged += chains.popleft()[1]
        if entries and at != newest:
            merged.append(at)
            newest, entries = at, at < begin + span
        if merged:
            chains.append((at, merged))
    return sorted((first, last) for last, firsts in chains for first in firsts)


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Slices of sorted batches with one key each; whether the key is a new one."""
    last: tuple | None = None
    for batch in batches:
        ids = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[at]:
                yield ids[at], ids[at] != last, batch.slice(at, i - at)
                last, at = ids[at], i


def _emit(kinds: list[pa.DataType], names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def stretches(samples: DataFrame, span: float, keys: Sequence[str], ts: str) -> DataFrame:
    """keys, __stretch, __in, __last: the time kept last before each stretch (null before the first), and whether it is the key's last stretch."""
    keys = list(keys)
    step, wide = round(span * 1e6), max(_DAY, SPANS * round(span * 1e6))
    kinds = [samples.schema[k].dataType for k in keys]
    head = ", ".join(f"`{k}` {t.simpleString()}" for k, t in zip(keys, kinds, strict=True))
    arrow = [to_arrow_type(t) for t in kinds] + [pa.int64()]
    timed = samples.select(*keys, F.floor(_micros(ts) / wide).alias("__stretch"), _micros(ts).alias("__at"))
    dealt = timed.repartition(*keys, "__stretch").sortWithinPartitions(*keys, "__stretch", "__at")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "__stretch", "__first", "__out"]

        def each() -> Iterator[tuple[tuple, Iterator[int]]]:
            """The times of each (key, stretch), streamed."""
            runs = _runs(batches, [*keys, "__stretch"])
            held = next(runs, None)
            while held:
                key = held[0]

                def times() -> Iterator[int]:
                    nonlocal held
                    yield from held[2].column("__at").to_pylist()
                    for held in runs:
                        if held[1]:
                            return
                        yield from held[2].column("__at").to_pylist()
                    held = None

                yield key, times()

        for key, times in each():
            rows = [(*key, first, out) for first, out in outlets(times, key[-1] * wide, step)]
            yield _emit([*arrow, pa.int64(), pa.int64()], names, rows)

    found = dealt.mapInArrow(walked, f"{head}, __stretch long, __first long, __out long")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, series, at, rows = [*keys, "__stretch", "__in", "__last"], None, None, []
        took: bool | None = None
        for key, new, run in _runs(batches, [*keys, "__stretch"]):
            if new:
                if series is not None and key[:-1] != series:
                    rows[-1] = (*rows[-1][:-1], True)
                if len(rows) >= 4096:
                    yield _emit([*arrow, pa.int64(), pa.bool_()], names, rows[:-1])
                    rows = rows[-1:]
                at = None if key[:-1] != series else at
                series, took = key[:-1], False
                rows.append((*key, at, False))
            if not took:
                for first, out in zip(run.column("__first").to_pylist(), run.column("__out").to_pylist(), strict=True):
                    if at is None or first >= at + step:
                        at, took = out, True
                        break
        if rows:
            rows[-1] = (*rows[-1][:-1], True)
            yield _emit([*arrow, pa.int64(), pa.bool_()], names, rows)

    ordered = found.repartition(*keys).sortWithinPartitions(*keys, "__stretch", "__first")
    return ordered.mapInArrow(joined, f"{head}, __stretch long, __in long, __last boolean")


def thin(samples: DataFrame, span: float, keys: Sequence[str] = ("host",), order: Sequence[str] = ("ts", "seq"), keep_last: bool = False) -> DataFrame:
    """Of each key, the first row and every row at least ``span`` seconds after the last kept one (maybe the last row too)."""
    keys, order, names = list(keys), list(order), samples.columns
    step, wide = round(span * 1e6), max(_DAY, SPANS * round(span * 1e6))
    if step <= 0:
        return samples
    found = stretches(samples, span, keys, order[0])
    same = [samples[k].eqNullSafe(found[k]) for k in keys]
    placed = samples.withColumns({"__at": _micros(order[0]), "__of": F.floor(_micros(order[0]) / wide)})
    joined = placed.join(found, [*same, F.col("__of") == F.col("__stretch")]).select(*(placed[c] for c in [*names, "__at", "__of"]), "__in", "__last")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, held_kept = None, None, True
        for _, new, run in _runs(batches, [*keys, "__of"]):
            if new:
                if held is not None and not held_kept:
                    yield held
                kept = run.column("__in")[0].as_py()
            mask = []
            for at in run.column("__at").to_pylist():
                mask.append(kept is None or at - kept >= step)
                if mask[-1]:
                    kept = at
            rows = run.select(names)
            yield rows.filter(pa.array(mask))
            # The last row of the key's last stretch waits for what comes after it.
            held, held_kept = (rows.slice(len(mask) - 1), mask[-1]) if keep_last and run.column("__last")[0].as_py() else (None, True)
        if held is not None and not held_kept:
            yield held

    return joined.repartition(*keys, "__of").sortWithinPartitions(*keys, "__of", *order).mapInArrow(walk, samples.schema)
