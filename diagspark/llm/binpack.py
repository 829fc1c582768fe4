"""Best-fit packing of tokenised documents with certified numbers of sequences.

The pieces are dealt into groups of some thousands, and each group is packed
best fit decreasing. A dual feasible function turns lengths into weights of
which no sequence can hold more than its unit, so the weight of a group over
the unit is a lower bound of its sequences; the best of several hundred such
functions certifies the group's number or shows a gap. Groups with a gap give
up their sequences with room, certified ones only their emptiest; what was given
up is dealt anew and packed again, until one group holds it all or a round
saves nothing. Only numbers move: texts and ids stay in the tasks that read them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .packing import shared_tokenizer, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Pieces of a group, in the mean.
GROUP = 1 << 13
ROUNDS = 12
#: Words that a generation of a worker's cache may hold: two of them take some 200 MB.
WORDS = 500_000
_PIECE_BYTES = 1 << 20
#: A group's sequences are numbered within so many bits.
_BIN_BITS = 24


@lru_cache(4)
def dual_functions(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights by function and length, units): in whole numbers, the lengths of a feasible sequence never weigh more than the unit.

    The identity; u(k), rounding of multiples (Fekete and Schepers); U(e),
    which counts long pieces whole and drops the short ones that fit beside
    them (Martello and Toth); phi(e), which counts what still fits beside.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    weights, units = [x], [capacity]
    for k in range(1, 101):
        whole = (k + 1) * x % capacity == 0
        weights.append(np.where(whole, k * x, (k + 1) * x // capacity * capacity))
        units.append(capacity * k)
    for e in sorted({max(1, capacity * j // 256) for j in range(1, 129)}):
        weights.append(np.where(x > capacity - e, capacity, np.where(x < e, 0, x)))
        units.append(capacity)
        fit = capacity // e
        weights.append(np.where(2 * x > capacity, fit - (capacity - x) // e, np.where(x < e, 0, 1)))
        units.append(fit)
    return np.stack(weights), np.array(units, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of the lengths has fewer sequences."""
    weights, units = dual_functions(capacity)
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    return int((-(-(weights @ counts) // units)).max()) if len(lengths) else 0


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece: longest first, each into the fullest sequence that has room."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # rooms: bit r is set if a sequence has room r
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            here = open_by_room[room]
            at = here.pop()
            if not here:
                rooms ^= 1 << room
        else:
            at, room, used = used, capacity, used + 1
        place[i], offset[i] = at, capacity - room
        if left := room - n:
            open_by_room[left].append(at)
            rooms |= 1 << left
    return place, offset


def repack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, given up) of each piece of a group."""
    place, offset = best_fit_decreasing(lengths, capacity)
    room = capacity - np.bincount(place, lengths).astype(np.int64)
    if len(room) > lower_bound(lengths, capacity):
        loose = room > 0
    else:
        loose = np.arange(len(room)) == np.argmax(room)
        loose &= room > 0
    return place, offset, loose[place]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth: a row for each piece of a document's ids, written to the shared folder."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared_tokenizer(path, WORDS)
        end, part, nth = np.array([end_id], tokenizer.kind).tobytes(), TaskContext.get().partitionId(), 0

        def rows(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            nonlocal nth
            raw = [r + end for r in tokenizer.encode(texts)]
            wide = memoryview(np.frombuffer(b"".join(raw), tokenizer.kind).astype("<u4").tobytes())
            sizes = np.array([len(r) for r in raw], np.int64) // tokenizer.kind.itemsize
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(raw)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            first = ((np.cumsum(sizes) - sizes)[doc] + start) * 4
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(first.tolist(), (first + length * 4).tolist(), strict=True)]
            columns = [ids.take(pa.array(doc)), pa.array(piece), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int64)), pa.array(np.arange(nth, nth + len(doc)))]
            nth += len(doc)
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            at = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= _PIECE_BYTES or i == len(texts) - 1:
                    yield rows(ids.slice(at, i + 1 - at), texts[at : i + 1])
                    at, size = i + 1, 0

    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stored(whole.mapInArrow(cut, f"doc_id {id_type}, piece long, start long, length long, ids_crc32 long, part long, nth long"), "pieces")


def _repacker(capacity: int, high: int) -> Callable[[pa.Table], pa.Table]:
    """Packs the pieces of one group; ``high`` marks the round in the ids of its sequences."""

    def again(table: pa.Table) -> pa.Table:
        place, offset, loose = repack(table.column("length").to_numpy(), capacity)
        sequence = high | table.column("group")[0].as_py() << _BIN_BITS | place
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("loose", pa.array(loose))

    return again


def packed_best_fit(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only one of over ``capacity`` ids is
    cut, every ``capacity`` ids. Null and empty texts are the end id alone.
    Repeated rows are packed as often as they occur, and of equal lengths any
    order is right; an empty table gives no rows. Other columns are ignored.
    Sequence ids are unique but have gaps. The driver sees two counts a round.
    """
    open_ = token_pieces(docs, path or tokenizer_path(), capacity, end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = {f.name: f.dataType.simpleString() for f in open_.schema}
    out_type = ", ".join(f"{c} {kinds[c]}" for c in [*names, "part", "nth"]) + ", sequence_id long, offset long, loose boolean"
    final, used = [], None
    for round_ in range(ROUNDS):
        n = open_.count()
        groups = max(1, -(-n // group))
        if not n and final:
            break
        number = F.pmod(F.xxhash64("part", "nth", F.lit(round_)), F.lit(groups))
        high = round_ << 58

        dealt = stored(open_.select(*names, "part", "nth", number.alias("group")).groupBy("group").applyInArrow(_repacker(capacity, high), out_type), "packed")
        first = F.col("offset") == 0
        counts = dealt.agg(F.count_if(first).alias("used"), F.count_if(first & F.col("loose")).alias("loose")).first()
        if groups == 1 or not counts["loose"] or round_ == ROUNDS - 1 or used is not None and counts["used"] >= used:
            final.append(dealt)
            break
        final.append(dealt.where(~F.col("loose")))
        open_, used = dealt.where("loose"), counts["loose"]
    whole = final[0]
    for more in final[1:]:
        whole = whole.unionByName(more)
    return whole.select(*names, "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, lower bound over all pieces): equal if the packing is proved to be the best. The driver sees a count for each length."""
    counts = {r["length"]: r["n"] for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    weights, units = dual_functions(capacity)
    # In whole numbers of any size, as counts may be large.
    sums = [sum(int(w) * n for w, n in zip(row[list(counts)], counts.values(), strict=True)) for row in weights] if counts else [0]
    return packed.select("sequence_id").distinct().count(), max(-(-s // int(u)) for s, u in zip(sums, units, strict=False))
