import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from diagspark.llm import lexical_search as L

from . import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    """Every item against every document."""
    rows = [(d, Counter(w), len(w)) for d, t in docs if (w := words(t))]
    n, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(words(t))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc, c, length in rows:
            m = 100 - 50 + (50 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_terms():
    for text in ("It's A-b_c ÉÀé 漢字 x1 \x85\x00z", "", " .,", "ẞ ſ K İ"):
        assert [t.decode() for t in L.terms_of(text.encode())] == words(text)


@pytest.mark.parametrize("block", [1 << 16, 12_000])
def test_awkward_rows(spark, block):
    items = [(1, "Number of the cat."), (2, None), (3, ""), (4, "?!"), (None, "los gatos"), (5, cases.LONG), (6, "zzz nothing"), (1, "und die Kinder"), (7, "The thing"), (7, "The thing")]
    frame = spark.createDataFrame([(*i, 3, "x") for i in items], "item_id long, text string, doc_id long, term string")
    got = L.ranked(cases.documents(spark), frame, 50, block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute([r[:2] for r in cases.rows()], items)


def test_trees_find_what_brute_force_finds_and_prune():
    rng = random.Random(4)
    words_ = [f"w{i}" for i in range(400)]
    # Documents of several kinds, ties and copies among them.
    docs = [(i, " ".join(rng.choices(words_[(i % 8) * 50 : (i % 8) * 50 + 60], k=rng.randint(1, 60)))) for i in range(3000)]
    docs += [(i, docs[i % 40][1]) for i in range(3000, 3400)]
    items = [(i, " ".join(rng.sample(words_[(i % 8) * 50 : (i % 8) * 50 + 50], 6))) for i in range(64)]
    vocabulary = {t: n for n, t in enumerate(words_)}
    counts = [Counter(words(t)) for _, t in docs]
    df = Counter(t for c in counts for t in c)
    weights = np.array([L.weight(len(docs), df[t]) for t in words_], float)
    total = sum(sum(c.values()) for c in counts)

    def sparse(rows, value):
        flat = [(r, vocabulary[t], value(r, t)) for r, ts in enumerate(rows) for t in ts]
        return L.Sparse(len(rows), *(np.array(x) for x in zip(*flat, strict=True)))

    impact = lambda r, t: int(L.impacts(np.array(counts[r][t]), np.array(sum(counts[r].values())), len(docs), total))
    search = L.Search(sparse([set(words(t)) for _, t in items], lambda r, t: weights[vocabulary[t]]), weights, 10, np.zeros(len(items)))
    search.add(sparse(counts, impact), [d for d, _ in docs], weights)
    got = sorted(((i, rank, -d, s) for i, heap in enumerate(search.best) for rank, (s, d) in enumerate(sorted(heap, reverse=True), 1)), key=str)
    assert got == brute(docs, items, 10)
    leaves = lambda node: sum(map(leaves, node.children)) or 1
    pairs = leaves(search.tree) * leaves(L.hierarchy(sparse(counts, impact), weights, L.LEAF_DOCUMENTS))
    assert search.scored < 0.25 * pairs


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, L.ranked(docs, items).collect()), key=str)
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert got == sorted(connection.execute(L.ORACLE_SQL).fetchall(), key=str)
    small = [tuple(r) for r in items.orderBy("item_id").limit(6).select("item_id", "text").collect()]
    mine = {i for i, _ in small}
    assert [r for r in got if r[0] in mine] == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], small)


def test_empty_tables(spark):
    docs, items = cases.documents(spark), spark.createDataFrame([(1, "the")], "item_id long, text string")
    none = F.lit(False)
    assert L.ranked(docs.where(none), items).collect() == [] == L.ranked(docs, items.where(none)).collect()
