import corpus_pipeline as C
from pyspark.sql import functions as F

from diagspark.llm import packing as P
from diagspark.llm import quality as Q

from . import cases
from .test_packing import check
from .test_simhash import plain_components, plain_fingerprint


def test_stages_take_effect(spark, tmp_path):
    """Each stage against plain Python over what its predecessor kept."""
    folder = cases.write(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = C.quality(spark, docs, folder)
    model = Q.train_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = [r for r in docs.collect() if model.score(Q.feature_rows([r["text"]]))[0] >= 0.5]
    assert kept.columns == columns and sorted(map(str, kept.collect())) == sorted(map(str, good))
    spoken = C.language(spark, docs, folder)
    ids = {r["doc_id"] for r in spoken.collect()}
    assert spoken.columns == columns and not ids & {60, 61, 62, 70} and {1, 2, 3, 4} <= ids
    single = C.near_dedup(spark, spoken, folder).collect()
    prints = [plain_fingerprint(r["text"]) for r in spoken.collect()]
    assert len(single) == len(set(plain_components(sorted(set(prints))).values()))
    mixed = C.mixing(spark, spoken, folder)
    assert mixed.columns == columns and sorted(map(str, mixed.collect())) == sorted(map(str, spoken.collect()))
    check(C.packing(spark, mixed, folder).collect(), [(r["doc_id"], r["text"]) for r in spoken.collect()])


def test_run_on_whole_table(spark):
    pieces = C.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    kept = sorted({p["doc_id"] for p in pieces})
    check(pieces, [(d, docs[d]) for d in kept])
    roots = plain_components(sorted({plain_fingerprint(docs[d]) for d in kept}))
    assert len(set(roots.values())) == len(kept)


def test_empty_table(spark, tmp_path):
    cases.documents(spark).where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    cases.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_near_copies_go(spark, tmp_path):
    """Copies with a Jaccard similarity of 0.8 and more over five words leave one; less similar texts stay."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, want = [], set()
    for i in range(40):
        base = [word() for _ in range(300)]
        rows.append((10 * i, base))
        want.add(10 * i)
        for k, changes in enumerate((3, 5, 6, 20), 1):
            copy = list(base)
            for at in rng.sample(range(5, 290), changes):
                copy[at] = word()
            one, two = sets(base), sets(copy)
            rows.append((10 * i + k, copy))
            if len(one & two) < 0.8 * len(one | two):
                want.add(10 * i + k)
    docs = spark.createDataFrame([(i, " ".join(t), "en", "src0") for i, t in rows], "doc_id long, text string, lang string, source string")
    assert 60 < len(want) < 160
    kept = {r["doc_id"] for r in C.near_dedup(spark, docs, str(tmp_path)).collect()}
    # The index is probabilistic: just over 0.8 it finds some 99 % of the pairs.
    assert want <= kept and len(kept - want) <= 0.02 * (len(rows) - len(want))


def test_sequences_follow_the_targets(spark, tmp_path):
    """A source with two thirds of the tokens and a target of half fills half of the first windows."""
    text = "plain words of a long text " * 400
    docs = spark.createDataFrame([(i, text, "en", "hot" if i < 160 else f"src{i % 2}") for i in range(240)], "doc_id long, text string, lang string, source string")
    pieces = C.packing(spark, docs, str(tmp_path)).collect()
    early = [p for p in pieces if p["sequence_id"] < 128]
    share = sum(p["length"] for p in early if p["source"] == "hot") / sum(p["length"] for p in early)
    assert abs(share - 0.5) < 0.001
    check(pieces, [(i, text) for i in range(240)])


def test_sequence_length():
    assert P.SEQUENCE == 2048
