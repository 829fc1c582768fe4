import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from diagspark.llm import simhash as S

from . import cases


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            parent[root(a)] = root(b)
    return {p: root(p) for p in prints}


@pytest.mark.parametrize("width", [2, 3, 4])
def test_any_four_positions_contain_a_set(width):
    sets = S.position_sets(width)
    assert len(sets) == {2: 7, 3: 20, 4: 70}[width]
    assert all(any(set(s) <= set(four) for s in sets) for four in itertools.combinations(range(8), 4))


def check(frame, rows):
    found = [tuple(r) for r in frame.collect()]
    prints = {(d, t): plain_fingerprint(t) for d, t in rows}
    root = plain_components(sorted(set(prints.values())))
    least = defaultdict(list)
    for (d, _), p in prints.items():
        if d is not None:
            least[root[p]].append(d)
    want = [(d, f"{plain_fingerprint(t):016x}", min(least[root[plain_fingerprint(t)]], default=None)) for d, t in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=key) == sorted(want, key=key)


def test_equals_brute_force_on_awkward_rows(spark):
    docs = cases.documents(spark)
    check(S.near_duplicates(docs), [(r[0], r[1]) for r in cases.rows()])


def test_equals_brute_force_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(S.near_duplicates(docs), [tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("block", [4096, 50])
def test_links_of_dense_groups(spark, monkeypatch, block):
    """A crowd around one fingerprint: blocks and forests must connect what brute force connects."""
    monkeypatch.setattr(S, "BLOCK_ROWS", block)
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for centre in list(prints)[:3]:
        for _ in range(150):
            p = centre
            for _ in range(rng.randint(1, 5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    got = {r["fp"]: r["component"] for r in S.near_classes(spark.createDataFrame(signed, "fp long")).collect()}
    want = plain_components(sorted(prints))
    groups = lambda m, f: {frozenset(k for k in m if m[k] == v) for v in set(m.values())} if f is None else {frozenset(f(k) for k in g) for g in f(None)}
    back = {int(np.int64(k).astype(np.uint64)): v for k, v in got.items()}
    assert groups(back, None) == groups(want, None)


def test_one_of_each_group_stays(spark):
    docs = cases.documents(spark)
    kept = S.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    classes = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in S.near_duplicates(docs).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in classes.values() if c is not None})
    assert ids.count(None) == 1  # the text without an id; the null text without one joins the empty texts


def test_crowds_of_similar_texts_are_one(spark, monkeypatch):
    """Large posting lists: a few nearest candidates first, then rounds for what they left out."""
    monkeypatch.setattr(S, "NEAREST", 1)
    monkeypatch.setattr(S, "_FEW", 2)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for crowd in range(3):
        base = [word() for _ in range(200)]
        for i in range(60):
            copy = list(base)
            copy[rng.randrange(200)] = word()
            rows.append((1000 * crowd + i, " ".join(copy), 0, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, key string")
    kept = S.without_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1000, 2000]


def similar_pairs(texts):
    """All pairs of different texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more, by their rarest shingles: exact."""
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))))
    often = defaultdict(int)
    for s in sets:
        for gram in s:
            often[gram] += 1
    lists, found = defaultdict(list), set()
    for i, s in enumerate(sets):
        # Similar sets share one of the rarest fifth of both, and one more.
        for gram in sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-4 * len(s) // 5) + 1]:
            for j in lists[gram]:
                if sets[j] != s and 5 * len(sets[j] & s) >= 4 * len(sets[j] | s):
                    found.add((j, i))
            lists[gram].append(i)
    return found


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_no_similar_pair_of_a_table_stays(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    texts = [r["text"] for r in docs.select("text").collect()]
    assert sf == "0.001" or similar_pairs(texts)
    kept = [r["text"] for r in S.without_similar(docs).select("text").collect()]
    assert not similar_pairs(kept) and len({" ".join((t or "").lower().split()) for t in kept}) == len(kept)


def test_empty_table(spark):
    docs = cases.documents(spark).where(F.lit(False))
    assert S.near_duplicates(docs).collect() == []
    assert S.without_near_duplicates(docs).collect() == []


def test_sketches_come_from_one_python_function(spark):
    found = S.sketches(cases.documents(spark))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    marks = S.fingerprints(cases.documents(spark)).select("doc_id", "fp")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["fp"])
    assert sorted(map(key, found.collect())) == sorted(map(key, marks.collect()))


def test_components_take_the_state_as_edges_are_written(spark, monkeypatch):
    """As a plain union-find gives them, and no edge is read again for the state of a round."""
    from diagspark.llm.graph import components

    order = random.Random(3)
    pairs = [(order.randrange(60), order.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(12)] + [(200, i) for i in range(201, 215)]
    root = {n: n for pair in pairs for n in pair}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {n: root[n] for a, b in pairs if a != b for n in (a, b)}
    links = spark.createDataFrame([*pairs, (None, 1), (5, None)], "a long, b long")
    monkeypatch.setattr(type(links), "first", lambda self: pytest.fail("edges were read again"))
    found = components(links, "a", "b").collect()
    assert len(found) == len(want) and {r["node"]: r["component"] for r in found} == want
    assert components(links.where("a < 0"), "a", "b").collect() == []


def test_both_kinds_of_links_share_one_search_for_components(spark, monkeypatch):
    from diagspark.llm import _common

    docs = cases.documents(spark)
    made, plain = [], _common.scratch
    monkeypatch.setattr(_common, "scratch", lambda session, name: made.append(name) or plain(session, name))
    kept = {r["doc_id"] for r in S.without_similar(docs).collect()}
    assert {r["component_id"] for r in S.near_duplicates(docs).collect() if r["component_id"] is not None} >= kept - {None}
    # One search is near_duplicates' own.
    assert made.count("edges") == 2
