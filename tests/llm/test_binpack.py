import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from diagspark.llm import binpack as B
from diagspark.llm.packing import tokenizer_path

from . import cases


def fewest(lengths, capacity):
    """The least number of sequences, by trying every placement."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= lengths[i]:
                rooms[k] -= lengths[i]
                place(i + 1, rooms)
                rooms[k] += lengths[i]
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("capacity", [12, 20, 31])
def test_functions_are_dual_feasible(capacity):
    weights, units = B.dual_functions(capacity)

    def fillings(room, least):
        yield []
        for n in range(least, room + 1):
            for rest in fillings(room - n, n):
                yield [n, *rest]

    for filling in fillings(capacity, 2 if capacity > 12 else 1):
        assert (weights[:, filling].sum(axis=1) <= units).all(), filling


def test_bound_and_best_fit_hold_the_optimum():
    rng = random.Random(3)
    for _ in range(120):
        lengths = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 9))])
        place, offset = B.best_fit_decreasing(lengths, 20)
        best = fewest(sorted(lengths.tolist(), reverse=True), 20)
        assert B.lower_bound(lengths, 20) <= best <= place.max() + 1
        for at in range(place.max() + 1):
            parts = sorted(zip(offset[place == at].tolist(), lengths[place == at].tolist(), strict=True))
            assert [a for a, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= 20


def test_bound_certifies_where_the_volume_does_not():
    lengths = np.array([11] * 6 + [9, 8] + [7] * 2)
    assert -(-lengths.sum() // 20) < B.lower_bound(lengths, 20) == fewest(sorted(lengths.tolist(), reverse=True), 20) == 6


def check(pieces, rows, capacity=2048):
    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("group", [1 << 13, 9])
def test_awkward_rows(spark, group):
    got = B.packed_best_fit(cases.documents(spark), group=group)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    used = check(got.collect(), [(r[0], r[1]) for r in cases.rows()])
    counted, bound = B.certificate(got)
    assert used == counted and bound <= used <= bound + 8 * (group < 100)


def test_whole_table_is_near_its_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    one, dealt = (B.packed_best_fit(docs, group=g) for g in (1 << 13, 100))
    used, bound = B.certificate(one)
    assert check(one.collect(), rows) == used <= bound + 1
    assert check(dealt.collect(), rows) <= bound + 3


def test_small_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 60)) for i in range(400)], "doc_id long, text string")
    got = B.packed_best_fit(docs, capacity=40, group=50)
    check(got.collect(), [(i, "word " * (i % 60)) for i in range(400)], 40)
    used, bound = B.certificate(got, 40)
    assert used <= 1.02 * bound


def test_empty_table(spark):
    assert B.packed_best_fit(cases.documents(spark).where(F.lit(False))).collect() == []
