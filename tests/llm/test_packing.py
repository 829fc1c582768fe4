import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from diagspark.llm import packing as P

from . import cases


def ids_of(texts):
    library = Tokenizer.from_file(P.tokenizer_path())
    return [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def check(pieces, rows, sequence=2048):
    """Each id lies in one piece, sequences are gapless, and only the last is not full."""
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    want = defaultdict(list)
    for (doc, _), ids in zip(rows, ids_of([t for _, t in rows]), strict=True):
        want[doc].append(ids)
    assert by_doc.keys() == want.keys()
    for doc, copies in want.items():
        crcs = defaultdict(int)
        for ids in copies:
            for p in by_doc[doc]:
                part = ids[p["start"] : p["start"] + p["length"]]
                if p["doc_tokens"] == len(ids) and zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]:
                    crcs[p["start"]] += 1
        assert sum(p["length"] for p in by_doc[doc]) == sum(map(len, copies))
        assert all(crcs[p["start"]] for p in by_doc[doc])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == sequence or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


def test_word_tokenizer_equals_library():
    texts = [r[1] or "" for r in cases.rows()] + ["X  y z", "it's 'twas rock'n'roll", "<|startoftext|>", "áb ́c"]
    own = P.WordTokenizer(P.tokenizer_path())
    library = Tokenizer.from_file(P.tokenizer_path())
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_word_tokenizer_equals_library_on_special_strings_of_any_case():
    own = P.WordTokenizer(P.tokenizer_path(), generation=300)
    library = Tokenizer.from_file(P.tokenizer_path())
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "x", " ", "été!!", "don't", "B\u0301", "12", "\u1e9e", "\u03a3", "\x85", "\ufb01", "###"]
    mixed = lambda s: "".join(c.upper() if rng.random() < 0.5 else c for c in s)
    texts = ["x<|ENDOFTEXT|>y"] + ["".join(mixed(rng.choice(parts)) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        for text, raw in zip(texts[at : at + 100], own.encode(texts[at : at + 100]), strict=True):
            assert np.frombuffer(raw, own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("weights", [None, {"src0": 0.5, "src1": 0.3, "src2": 0.1}])
def test_pieces_of_awkward_rows(spark, weights):
    docs = cases.documents(spark)
    check(P.packed(docs, weights=weights).collect(), [(r[0], r[1]) for r in cases.rows()])


def test_pieces_of_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(P.packed(docs, window_sequences=4).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_windows_hold_target_proportions():
    quanta = P.Quanta.of([1000, 3000, 6000], [1.0, 3.0, 6.0], 100)
    after = np.stack([quanta.after(q, np.arange(101)) for q in range(3)])
    served = np.diff(after, axis=1)
    assert (abs(served - np.array([[10], [30], [60]])) <= 1).all()
    assert after[:, -1].tolist() == [1000, 3000, 6000]


def test_quanta_grow_when_a_queue_runs_dry():
    quanta = P.Quanta.of([100, 1000], [0.5, 0.5], 100)
    served = np.diff(np.stack([quanta.after(q, np.arange(12)) for q in range(2)]), axis=1)
    assert served[:, 0].tolist() == [50, 50] and served[:, 1].tolist() == [50, 50] and served[:, 2].tolist() == [0, 100]
    assert served.sum() == 1100


def test_empty_table(spark):
    assert P.packed(cases.documents(spark).where(F.lit(False))).collect() == []


def test_special_strings_are_found():
    assert re.search(P.WordTokenizer(P.tokenizer_path()).special, "x<|endoftext|>")


def test_the_query_keeps_as_many_words_as_best_fit_packing(monkeypatch):
    from diagspark.llm import binpack, queries

    asked = {}
    monkeypatch.setattr(queries, "packed", lambda docs, **options: asked.update(options))
    monkeypatch.setattr(queries, "table", lambda *_: None)
    queries.op9_packing(None, "")
    assert asked["generation"] == binpack.WORDS
