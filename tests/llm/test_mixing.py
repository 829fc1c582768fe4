import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from diagspark.llm import mixing as M

from . import cases


@pytest.mark.parametrize("blocks", [[1], [3, 5, 8], [512, 256, 128, 64, 32, 16, 8, 4, 2, 2], [1, 1, 1, 1021], [333, 333, 358]])
def test_pfair_stays_within_a_block_of_every_target(blocks):
    period = sum(blocks)
    slots = M.pfair_period(blocks)
    assert sorted(np.concatenate(slots)) == list(range(period))
    for n, s in zip(blocks, slots, strict=True):
        given = np.cumsum(np.isin(np.arange(period), s))
        assert (abs(given - np.arange(1, period + 1) * n / period) < 1).all()


def test_phases_place_every_block_once():
    counts = [1, 40, 7, 300, 0, 12]
    phases = M.pfair_phases(counts, [1, 5, 2, 3, 1, 1], period=64)
    source = np.repeat(np.arange(len(counts)), counts)
    block = np.concatenate([np.arange(n) for n in counts])
    slots = M.slots_of(phases, source, block)
    assert sorted(slots) == list(range(sum(counts)))
    assert all((np.diff(slots[source == i]) > 0).all() for i in range(len(counts)))


@pytest.mark.parametrize("counts, weights", [([6000] + [600] * 19, None), ([4000, 3000, 2000], [0.5, 0.3, 0.2]), ([5000, 60, 70], [0.9995, 0.0004, 0.0001]), ([512 * 20, *[26 * 20] * 20], [0.5, *[0.025] * 20])])
def test_phases_stay_within_a_block_of_the_given_weights(counts, weights):
    """Over many periods of 1,024 slots, as long as every source has blocks left."""
    weights = weights or M.target_weights(dict(enumerate(counts)), None, 0.5)
    phases = M.pfair_phases(counts, weights)
    source = np.repeat(np.arange(len(counts)), counts)
    slots = M.slots_of(phases, source, np.concatenate([np.arange(n) for n in counts]))
    end = min(slots[source == i].max() for i in range(len(counts))) + 1
    assert end > 4 * 1024
    for i, w in enumerate(weights):
        given = np.cumsum(np.bincount(slots[source == i], minlength=end)[:end])
        assert (abs(given - np.arange(1, end + 1) * (w / sum(weights))) < 1 + 1e-6).all()


def test_every_document_has_a_place(spark):
    docs = cases.documents(spark)
    plan = M.mixture_plan(docs, block_docs=2).collect()
    assert Counter(r["doc_id"] for r in plan) == Counter(r[0] for r in cases.rows())
    assert len({(r["slot"], r["place"]) for r in plan}) == len(plan)
    assert all(len({r["source"] or "" for r in plan if r["slot"] == s}) == 1 for s in {r["slot"] for r in plan})
    assert {r["slot"] for r in plan} == set(range(len({r["slot"] for r in plan})))


def test_layout_keeps_rows_and_columns(spark):
    docs = cases.documents(spark)
    laid = M.in_mixture_order(docs, weights={"src0": 0.6, "src1": 0.4})
    assert laid.columns == docs.columns
    assert sorted(map(str, laid.collect())) == sorted(map(str, docs.collect()))


def plain_edf(counts, weights):
    """Slots by exact fractions, one at a time, with the releases and deadlines of the sources that have blocks left."""
    given, left, start, base = [0] * len(counts), set(range(len(counts))), 0, [0] * len(counts)
    slots = [[] for _ in counts]
    for slot in range(sum(counts)):
        total = sum(Fraction(weights[i]) for i in left)
        share = {i: Fraction(weights[i]) / total for i in left}
        k = {i: given[i] - base[i] for i in left}
        free = [i for i in left if k[i] / share[i] // 1 <= slot - start]
        i = min(free, key=lambda i: (math.ceil((k[i] + 1) / share[i]), i))
        slots[i].append(slot)
        given[i] += 1
        if given[i] == counts[i]:
            left.discard(i)
            start, base = slot + 1, list(given)
    return slots


def test_plan_equals_plain_edf_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = M.mixture_plan(docs).collect()
    counts = Counter(r["source"] or "" for r in docs.collect())
    names = sorted(counts)
    blocks = [-(-counts[n] // 8) for n in names]
    slots = plain_edf(blocks, [b**0.5 for b in blocks])
    assert sorted((r["source"] or "", r["block"], r["slot"]) for r in plan if r["place"] == 0) == sorted((n, b, s) for n, own in zip(names, slots, strict=True) for b, s in enumerate(own))
    assert all(len({r["slot"] for r in plan if ((r["source"] or ""), r["block"]) == key}) == 1 for key in {((r["source"] or ""), r["block"]) for r in plan})


def test_plan_does_not_depend_on_partitions(spark):
    docs, found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "32", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, M.mixture_plan(docs).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_columns_of_any_name_are_kept(spark):
    names = ("_queue", "_row", "__key", "row", "queue", "bucket", "slot", "place", "rank", "n")
    docs = cases.documents(spark).select("doc_id", "text", "source", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    laid = M.in_mixture_order(docs)
    assert laid.columns == docs.columns
    assert sorted(map(str, laid.collect())) == sorted(map(str, docs.collect()))


def test_large_tables_have_larger_blocks():
    assert M._block_size({"a": 100, "b": 9}, 8) == 8
    assert M._block_size({"a": 1 << 30}, 8) == 1 << 11


def test_empty_table(spark):
    assert M.mixture_plan(cases.documents(spark).where(F.lit(False))).collect() == []
