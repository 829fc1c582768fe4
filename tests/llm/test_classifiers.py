import zlib

import numpy as np
from pyspark.sql import functions as F

from diagspark.llm import langid as L
from diagspark.llm import quality as Q

from . import cases

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in Q.quality_scores(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in found.items())
    held = [(found[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_of_awkward_rows(spark):
    found = Q.quality_scores(cases.documents(spark), cases.labels(spark)).collect()
    assert len(found) == len(cases.rows())
    blank = {r["score"] for r in found if r["doc_id"] in (60, 61, 62)}
    assert len(blank) == 1
    none = Q.quality_scores(cases.documents(spark), cases.labels(spark).where(F.lit(False))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert Q.quality_scores(cases.documents(spark).where(F.lit(False)), cases.labels(spark)).collect() == []


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    plain, paired = Q.fit_additive(x, y, pairs=0), Q.fit_additive(x, y, pairs=1)
    right = lambda m: ((m.score(x) > 0.5) == y).mean()
    assert right(plain) < 0.65 and right(paired) > 0.95 and list(paired.pairs) == [(1, 0)]


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    model = Q.fit_additive(x, (x[:, 0] > 0.3).astype(float), rounds=10, pair_rounds=5)
    for row in x[:20]:
        b = [int((e < v).sum()) for e, v in zip(model.edges, row, strict=True)]
        total = model.constant + sum(t[k] for t, k in zip(model.single, b, strict=True)) + sum(t[b[i], b[j]] for (i, j), t in model.pairs.items())
        assert np.isclose(model.score(row[None])[0], 1 / (1 + np.exp(-total)))


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = L.languages(docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in found if r["held_out"]]) > 0.97


def test_languages_of_awkward_rows(spark):
    found = {r["doc_id"]: r for r in L.languages(cases.documents(spark)).collect()}
    for doc in (60, 61, 62, 70):
        assert (found[doc]["lang_pred"], found[doc]["score"]) == ("und", 0)
    assert np.mean([found[i]["lang_pred"] == ("en", "fr", "de", "es")[i % 4] for i in range(60)]) > 0.95
    bare = L.languages(cases.documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in bare} == {"und"}
    assert L.languages(cases.documents(spark).where(F.lit(False))).collect() == []


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(L, "_BLOCK", 1000)
    text = cases.LONG[:50_000]
    counts = L.trigram_counts(text)
    assert counts.sum() == len(text.encode())
    model = L.fit_languages(np.stack([L.trigram_counts(t) for t in (cases.ENGLISH, cases.GERMAN)]), ["en", "de"])
    assert np.allclose(model.margins([text]), counts @ model.weights / counts.sum(), atol=1e-6)


def test_quality_query_equals_plain_look_ups(spark):
    """Every document of a table: its features, one table entry each, summed one by one."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train_quality(docs, labels)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        bins = [sum(e < v for e in edges.tolist()) for edges, v in zip(model.edges, Q.text_features(r["text"]), strict=True)]
        total = model.constant + sum(float(t[k]) for t, k in zip(model.single, bins, strict=True)) + sum(float(t[bins[i], bins[j]]) for (i, j), t in model.pairs.items())
        want[r["doc_id"]] = 1 / (1 + np.exp(-total))
    found = Q.quality_scores(docs, labels).collect()
    assert model.pairs and len(found) == len(want) and all(np.isclose(r["score"], want[r["doc_id"]], atol=1e-12) for r in found)


def test_cuts_are_the_best_of_all():
    rng = np.random.default_rng(4)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 2.0)
    for _ in range(50):
        n = int(rng.integers(2, 12))
        g, h = rng.normal(size=n), rng.uniform(0.1, 1, n)
        every = [gain(g[:c], h[:c]) + gain(g[c:], h[c:]) - gain(g, h) for c in range(1, n)]
        best, cut = Q._split(g, h, 2.0)
        assert np.isclose(best, max(every)) and cut == int(np.argmax(every)) + 1


def plain_language(model, text):
    """The family of the best chance, then every pair of its languages: most won, then the greatest sum."""
    if not L.has_letter(text):
        return "und", 0.0
    counts = L.trigram_counts(text)
    margins = [sum(float(c) * float(w) for c, w in zip(counts[counts > 0], column[counts > 0], strict=True)) / max(counts.sum(), 1) for column in model.weights.T]
    chance = [1 / (1 + np.exp(-min(max(m * s, -20), 20))) for m, s in zip(margins, model.scale, strict=True)]
    family = max(range(len(model.families)), key=lambda k: (chance[k], -k))
    names, wins = model.members[family], {}
    for name in names:
        odds = [chance[len(model.families) + k] if a == name else 1 - chance[len(model.families) + k] for k, (a, b) in enumerate(model.pairs) if name in (a, b)]
        wins[name] = (sum(o > 0.5 for o in odds), sum(odds), min(odds, default=1.0))
    best = max(names, key=lambda n: wins[n][:2])
    return best, (chance[family] if len(model.families) > 1 else 1.0) * wins[best][2]


def test_languages_equal_the_plain_decision(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.train_languages(docs)
    want = {r["doc_id"]: plain_language(model, r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert len(model.families) > 1 and model.pairs
    for r in L.languages(docs).collect():
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and np.isclose(r["score"], score, atol=1e-4)


def test_training_counts_reach_the_driver_without_zeros(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    frame, sent = type(docs), []
    plain = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: sent.append(plain(self)) or sent[-1])
    L.train_languages(docs)
    (table,) = sent
    assert table.num_rows and table.nbytes < table.num_rows * 4 * L.DIMENSIONS / 4


def test_packed_counts_are_the_counts_in_the_same_order():
    texts = ["", "a", "the cat", "the cat ", "the cats", "der Hund", "the the the", cases.ENGLISH, cases.GERMAN]
    whole = [L.trigram_counts(t).astype(np.float32) for t in texts]
    packed = [L.packed_counts(x) for x in whole]
    for x, raw in zip(whole, packed, strict=True):
        back = np.zeros(L.DIMENSIONS, np.float32)
        L.unpacked_counts(raw, back)
        assert (back == x).all()
    assert sorted(range(len(texts)), key=lambda i: (whole[i].tobytes(), i)) == sorted(range(len(texts)), key=lambda i: (packed[i], i))
