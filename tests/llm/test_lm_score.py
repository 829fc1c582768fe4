import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from diagspark.llm import lm_score as M

from . import cases


def check(found, rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    model, counts = M.BackoffAutomaton(), Counter()
    for doc, text in rows:
        if not held(doc):
            model.learn(text)
            counts.update(M.words_of(text))
    n, v = sum(counts.values()), len(counts)
    totals = (n, v)
    model.root = lambda w: (counts[w] + 0.5) / (totals[0] + 0.5 * (totals[1] + 1))
    want = []
    for doc, text in rows:
        words = M.words_of(text)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((doc, held(doc), len(words), sum(counts[w] > 0 for w in words), n, base, model.score(text)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted((tuple(r) for r in found), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


@pytest.mark.parametrize("size", [6 << 20, 2000])
def test_equals_the_automaton_on_awkward_rows(spark, monkeypatch, size):
    monkeypatch.setattr(M, "CHUNK_BYTES", size)
    check(M.lm_scores(cases.documents(spark)).collect(), [(r[0], r[1]) for r in cases.rows()])


def test_equals_the_automaton_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(M.lm_scores(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    rows = [r for r in M.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_arcs_of_a_state_sum_to_one():
    model = M.BackoffAutomaton()
    for text in ("a b a c", "b b a", ""):
        model.learn(text)
    words = [*model.single, b"never seen"]
    for state in [*model.single]:
        total = sum(0.7 * model.root(w) + (0.3 * model.double.get((state, w), 0) / model.context[state]) for w in words)
        assert total == pytest.approx(1)


def test_empty_table(spark):
    assert M.lm_scores(cases.documents(spark).where(F.lit(False))).collect() == []


def test_pair_hashes_differ():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, (2, 10_000)).astype(np.uint64)
    keys = np.concatenate([M._pair_keys(a, b), M._pair_keys(b, a)])
    assert len(np.unique(keys)) == len(keys)


def test_many_shares_give_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(M, "SHARE_KEYS", 500)
    check(M.lm_scores(cases.documents(spark)).collect(), [(r[0], r[1]) for r in cases.rows()])


@pytest.mark.parametrize("size", [0, 1, M.HEADED - 1, M.HEADED, 5000])
def test_keys_come_back_from_messages(size):
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
    raw = M._pack_keys(keys)
    assert np.array_equal(M._unpack_keys(raw), keys) and len(raw) <= 8 * size


def test_chunks_are_not_moved_to_their_answers(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = M.lm_scores(cases.documents(spark))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(chunk") == 1 and "SortMergeJoin" in plan
        check(found.collect(), [(r[0], r[1]) for r in cases.rows()])
    finally:
        spark.conf.set(key, before)
