import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from diagspark.llm import iblt as B

from . import cases


def pieces(text):
    return {p.rstrip(" ") for p in re.findall(B.PIECE, text)}


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def check(found, rows):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    by_id = {}
    for d, t in order:
        by_id.setdefault(d, set()).add(t)
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in rows)
    prints = {}
    sure = 0
    for k, (doc, text) in enumerate(order):
        following = order[(k + 1) % len(order)]
        if len(by_id[doc]) > 1 or len(by_id[following[0]]) > 1 or sum(d == doc for d, _ in order) > 1:
            continue  # ties are ordered by hash: checked by count only
        half = len(text) // 2
        edit = text[: len(text) - half] + following[1][:half]
        (r,) = [r for r in found if r["doc_id"] == doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(likeness(text, edit)) and r["near_next"] == pytest.approx(likeness(text, following[1]))
        for t, p in ((text, r["fingerprint"]), (edit, r["edited_fingerprint"])):
            assert prints.setdefault(t, p) == p
        sure += 1
    return sure


def test_awkward_rows(spark):
    assert check(B.fingerprints(cases.documents(spark)).collect(), [(r[0], r[1]) for r in cases.rows()]) > 60


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert check(B.fingerprints(docs).collect(), rows) == len(rows)


def test_small_sketches_fail_and_larger_ones_do_not(spark):
    """Peeling recovers exactly what differs, or says that cells are left."""
    sets = spark.range(40).select(
        F.col("id").alias("row"), F.lit(1).alias("pair"),
        F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.xxhash64(F.col("id"), i.cast("long"))).alias("a"),
        F.transform(F.sequence(F.lit(1) + F.col("id"), F.lit(200) + 2 * F.col("id")), lambda i: F.xxhash64(F.col("id"), i.cast("long"))).alias("b"),
    )
    got = {r["row"]: r for r in B.differences(sets, ["row", "pair"], 5).collect()}
    assert 0 not in got
    assert all(got[i]["left"] > 0 or got[i]["differing"] == 3 * i for i in range(1, 40)) and sum(got[i]["left"] == 0 for i in range(1, 40)) > 35
    tight = B.differences(sets, ["row", "pair"], 5, 0)
    assert any(r["left"] > 0 for r in tight.collect())


def test_many_rows_without_an_id(spark):
    rows = [(None, f"line {i} of many\nand another {i % 7}") for i in range(300)] + [(i, f"text {i} with words") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = B.fingerprints(docs).collect()
    assert check(found, rows) == 49 and sum(r["doc_id"] is None for r in found) == 300
    following = {r["text"]: r["next_text"] for r in B.with_next(docs, 8).collect()}
    assert len(following) == 350
    at, seen = "text 0 with words", 0
    while seen == 0 or at != "text 0 with words":  # one ring of all texts
        at, seen = following[at], seen + 1
    assert seen == 350


@pytest.mark.parametrize("n", [1, 2])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(7, "one two three"), (9, "four five")][:n], "doc_id long, text string")
    assert check(B.fingerprints(docs).collect(), [tuple(r) for r in docs.collect()]) == n


def test_empty_table(spark):
    assert B.fingerprints(cases.documents(spark).where(F.lit(False))).collect() == []
