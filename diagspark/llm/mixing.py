"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks. A source of weight w has its i-th block
(from 0) released at slot floor(i/w) and due by slot ceil((i+1)/w); one block
runs in each slot, the released block with the earliest deadline first. Every
source then stays less than one block from its target share at every slot.
Times are fractions of whole numbers, so the given weights hold exactly. The
driver schedules blocks, not documents: one period where the weights are
multiples of 1/period, else eight bytes for each block, of which there are
half a million at most (blocks grow with the table). When a source has run
out, the others go on with their weights scaled up.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Parts of a source that are numbered apart, and the most blocks of a plan.
BUCKETS, MOST_BLOCKS = 4096, 1 << 19


def _whole_weights(weights: list[float]) -> list[int]:
    """The weights as whole numbers in exactly the same proportions."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    return [w // math.gcd(*whole) for w in whole]


def pfair_period(blocks: list[int]) -> list[np.ndarray]:
    """The slots that each source gets in one period of ``sum(blocks)`` slots, by earliest deadline first."""
    period = sum(blocks)
    pending = sorted((i * period // n, -(-(i + 1) * period // n), s) for s, n in enumerate(blocks) for i in range(n))
    ready: list[tuple[int, int]] = []
    slots: list[list[int]] = [[] for _ in blocks]
    at = 0
    for slot in range(period):
        while at < len(pending) and pending[at][0] <= slot:
            heapq.heappush(ready, pending[at][1:])
            at += 1
        due, source = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        slots[source].append(slot)
    return [np.array(s, np.int64) for s in slots]


def pfair_until_dry(left: list[int], weights: list[int]) -> list[np.ndarray]:
    """The slots that each source gets, by exact release times and deadlines, until one has none of its ``left`` blocks left."""
    total = sum(w for n, w in zip(left, weights, strict=True) if n)
    given = [0] * len(left)
    slots: list[array] = [array("q") for _ in left]
    ready = [(-(-total // w), s) for s, (n, w) in enumerate(zip(left, weights, strict=True)) if n]
    waiting: list[tuple[int, int]] = []
    heapq.heapify(ready)
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(given[s] + 1) * total // weights[s]), s))
        due, s = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        slots[s].append(slot)
        given[s] += 1
        slot += 1
        if given[s] == left[s]:
            return [np.array(x, np.int64) for x in slots]
        heapq.heappush(waiting, (given[s] * total // weights[s], s))


@dataclass
class Phase:
    """A stretch of slots in which the same sources have blocks left."""

    start: int
    period: int
    first: list[int]  # of each source, its first block in this phase
    slots: list[np.ndarray]


def pfair_phases(counts: list[int], weights: list[float], period: int = 1024) -> list[Phase]:
    """The phases that place all ``counts`` blocks; each ends when a source runs out.

    Where the weights of those left are multiples of 1/n for an n up to
    ``period``, a phase holds n slots and repeats; else it holds all its slots.
    """
    whole = _whole_weights(weights) if counts else []
    left, done, start, phases = list(counts), [0] * len(counts), 0, []
    while any(left):
        per = [w if n else 0 for w, n in zip(whole, left, strict=True)]
        per = [w // math.gcd(*per) for w in per]
        length = sum(per)
        if length <= period:
            slots = pfair_period(per)
            end = min((n - 1) // k * length + int(s[(n - 1) % k]) + 1 for n, k, s in zip(left, per, slots, strict=True) if n)
            used = [end // length * k + int(np.searchsorted(s, end % length)) for k, s in zip(per, slots, strict=True)]
        else:
            slots = pfair_until_dry(left, per)
            used = [len(s) for s in slots]
            end = length = sum(used)
        phases.append(Phase(start, length, list(done), slots))
        left = [n - u for n, u in zip(left, used, strict=True)]
        done = [n + u for n, u in zip(done, used, strict=True)]
        start += end
    return phases


def slots_of(phases: list[Phase], source: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The slot of each block of each source."""
    out = np.zeros(len(block), np.int64)
    for i in np.unique(source):
        mine = np.flatnonzero(source == i)
        first = np.array([p.first[i] for p in phases])
        # The last phase that begins at or before the block and gives the source any slots.
        at = np.searchsorted(first, block[mine], side="right") - 1
        for k in np.unique(at):
            rows, p = mine[at == k], phases[k]
            n = len(p.slots[i])
            rank = block[rows] - p.first[i]
            out[rows] = p.start + rank // n * p.period + p.slots[i][rank % n]
    return out


def target_weights(counts: dict[str, int], weights: dict[str, float] | None, temperature: float) -> list[float]:
    """The given weights (a source without one gets the smallest), or counts to the power ``temperature``."""
    if weights:
        least = min(w for w in weights.values() if w > 0)
        return [max(weights.get(s, least), 1e-12) for s in counts]
    return [float(n) ** temperature for n in counts.values()]


def _block_size(counts: dict[str, int], block_docs: int) -> int:
    """``block_docs``, or more where a table is so large that it would make over MOST_BLOCKS blocks."""
    return max(block_docs, -(-sum(counts.values()) // MOST_BLOCKS))


def _in_blocks(counts: dict[str, int], size: int) -> dict[str, int]:
    return {name: -(-n // size) for name, n in counts.items()}


def source_weights(docs: DataFrame, block_docs: int = 8, temperature: float = 0.5) -> dict[str, float]:
    """The default target weight of each source, as ``mixed`` takes it."""
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("queue")).count().orderBy("queue")
    counts = {r["queue"]: r["count"] for r in sizes.collect()}
    blocks = _in_blocks(counts, _block_size(counts, block_docs))
    return dict(zip(blocks, target_weights(blocks, None, temperature), strict=True))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 8, temperature: float = 0.5, period: int = 1024, columns: Sequence[str] = ("*",)) -> DataFrame:
    """row (a struct of the ``columns`` of ``docs``), queue, block, slot, place; (slot, place) is the order of the mixture.

    ``weights`` are the sources' target shares of blocks; without any a
    source's target is its number of blocks to the power ``temperature``.
    All documents stay. A null source counts as ''. Within a source documents
    lie by bucket of their id's hash, then by id, then by a hash of the text;
    repeated rows take places after one another. The plan does not depend on
    partitions. Only one row for each source, with its count, reaches the
    driver, which schedules at most MOST_BLOCKS blocks. An empty table gives
    no rows. Columns of any name are kept: they lie in ``row``.
    """
    spread = F.xxhash64("doc_id", F.length("text"))
    dealt = docs.select(
        F.struct(*columns).alias("row"), F.coalesce("source", F.lit("")).alias("queue"), F.pmod(spread, F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("order"),
    )
    # Several buckets a source, so a hot source is dealt to many tasks.
    sizes = dealt.groupBy("queue", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("queue", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["queue"]: r["n"] for r in sizes.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()}
    size = _block_size(counts, block_docs)
    blocks = _in_blocks(counts, size)
    numbered = dealt.withColumn("number", F.row_number().over(Window.partitionBy("queue", "bucket").orderBy("order")) - 1)
    ranked = numbered.join(offsets, ["queue", "bucket"]).withColumn("rank", F.col("before") + F.col("number"))
    placed = ranked.select("row", "queue", F.floor(F.col("rank") / size).alias("block"), (F.col("rank") % size).cast("int").alias("place"))
    names = {name: i for i, name in enumerate(blocks)}
    phases = pfair_phases(list(blocks.values()), target_weights(blocks, weights, temperature), period)

    @F.pandas_udf("long")
    def slot(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queue, block in columns:
            yield pd.Series(slots_of(phases, queue.map(names).to_numpy(np.int64), block.to_numpy(np.int64)))

    return placed.withColumn("slot", slot("queue", "block"))


def mixture_plan(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 8, temperature: float = 0.5) -> DataFrame:
    """doc_id, source, block, slot, place of every document (see ``mixed``)."""
    placed = mixed(docs, weights, block_docs, temperature, columns=("doc_id", "source"))
    return placed.select("row.doc_id", "row.source", "block", "slot", "place")


def in_mixture_order(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 8, temperature: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs``, laid out in the order of the mixture (sorted over all partitions)."""
    placed = mixed(docs, weights, block_docs, temperature)
    return placed.repartitionByRange("slot").sortWithinPartitions("slot", "place").select("row.*")
