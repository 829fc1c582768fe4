"""Language-model scores by a weighted backoff automaton.

The automaton has a root state and one state a context word. The root has an
arc for every known word, weighted with its smoothed share; the state of word
h has an arc for every word w that follows h in training, weighted with
``weight`` * C(h w) / c(h) + (1 - weight) * p(w), and a failure arc to the root
of weight 1 - ``weight`` (1 for a word that never was a context). A text is
read from left to right from the start state; the traversal carries its state
and adds up log10 weights.

Counts cover all training documents and never meet in one place. Documents are
encoded in chunks of bounded size. Each chunk sends the hashes of its words and
word pairs, dealt by hash, with its own counts; each share of the hashes adds
them up and answers with the totals of what more than one chunk holds. So a
chunk gets just the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucketed, fold, stored, whole

#: The end of a text is a token of its own, and the context of the first word.
END = b"\n"
CHUNK_BYTES = 6 << 20
#: Hashes that one share of the count adds up, about.
SHARE_KEYS = 1 << 21
#: Messages of fewer keys go without a header.
HEADED = 1024


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space, then the end token."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


@dataclass
class BackoffAutomaton:
    """The automaton of a corpus that fits in memory; the definition that the distributed form follows."""

    weight: float = 0.3
    single: dict[bytes, int] = field(default_factory=dict)
    context: dict[bytes, int] = field(default_factory=dict)
    double: dict[tuple[bytes, bytes], int] = field(default_factory=dict)

    def learn(self, text: str | None) -> None:
        before = END
        for word in words_of(text):
            self.single[word] = self.single.get(word, 0) + 1
            self.context[before] = self.context.get(before, 0) + 1
            self.double[before, word] = self.double.get((before, word), 0) + 1
            before = word

    def root(self, word: bytes) -> float:
        n, v = sum(self.single.values()), len(self.single)
        return (self.single.get(word, 0) + 0.5) / (n + 0.5 * (v + 1))

    def score(self, text: str | None) -> float:
        state, total = END, 0.0
        for word in words_of(text):
            arc = self.double.get((state, word))
            if arc:
                total += math.log10(self.weight * arc / self.context[state] + (1 - self.weight) * self.root(word))
            else:
                total += math.log10((1 - self.weight if self.context.get(state) else 1.0) * self.root(word))
            state = word
        return total


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of word pairs from those of their words."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Chunk:
    """Encoded texts: local word numbers of all tokens, the words' hashes, and the documents' ends."""

    def __init__(self, row: dict) -> None:
        self.words = np.frombuffer(row["words"], np.int32)
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs as (context, word) numbers in one, and each token's pair."""
        end = np.int64(0)  # the end token is word 0 of every chunk
        before = np.empty(len(self.words), np.int64)
        before[1:] = self.words[:-1]
        if len(before):
            before[0] = end  # later texts begin after an end token anyway
        return np.unique(before * len(self.hashes) + self.words, return_inverse=True)

    def trained(self) -> np.ndarray:
        """Whether each token lies in a training document."""
        return np.repeat(self.train, np.diff(self.ends, prepend=0))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one: a chunk's columns are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _encode(docs: DataFrame) -> DataFrame:
    """One row a chunk: its documents, and their tokens as numbers; in buckets by chunk, so that the answers come to them without moving them."""
    import xxhash

    rows = docs.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), whole("text").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bool] = []
        tokens: list[np.ndarray] = []
        number: dict[bytes, int] = {END: 0}
        size = 0

        def finish() -> pa.RecordBatch:
            nonlocal count
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            ends = np.cumsum([len(t) for t in tokens]).astype(np.int64)
            columns = {
                "chunk": pa.array([(part << 32) + count], pa.int64()),
                "ids": pa.array([ids], pa.list_(id_type)),
                "train": pa.array([np.array([not h for h in held], np.uint8).tobytes()], pa.binary()),
                "ends": pa.array([ends.tobytes()], pa.binary()),
                "words": pa.array([np.concatenate(tokens).astype(np.int32).tobytes()], pa.binary()),
                "hashes": pa.array([hashes.tobytes()], pa.binary()),
            }
            count += 1
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i in range(batch.num_rows):  # one text at a time: a batch holds many
                doc, out, text = (batch.column(c)[i].as_py() for c in ("doc_id", "held_out", "text"))
                words = words_of(text)
                tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                ids.append(doc)
                held.append(out)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield finish()
                    ids, held, tokens, number, size = [], [], [], {END: 0}, 0
        if ids:
            yield finish()

    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = rows.mapInArrow(encoded, f"chunk long, ids array<{kind}>, train binary, ends binary, words binary, hashes binary")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(chunks, "chunks", buckets, "chunk", compression="zstd")


def _dealt(keys: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by share and, in a share, by key; and the share of each in that order."""
    order = np.argsort(keys)
    share = ((keys[order] >> np.uint64(20)) % np.uint64(shares)).astype(np.int32)
    by_share = np.argsort(share, kind="stable")
    return order[by_share], share[by_share]


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys of eight bytes each; if many, how many have each first byte, then the other seven bytes of each."""
    if len(keys) < HEADED:
        return keys.astype("<u8").tobytes()
    heads = np.bincount((keys >> np.uint64(56)).astype(np.int64), minlength=256).astype("<u4").tobytes()
    return heads + keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    if len(raw) < 8 * HEADED:
        return np.frombuffer(raw, "<u8")
    heads = np.repeat(np.arange(256, dtype=np.uint8), np.frombuffer(raw, "<u4", 256))
    return np.concatenate([np.frombuffer(raw, np.uint8, offset=1024).reshape(-1, 7), heads[:, None]], axis=1).copy().view("<u8").ravel()


def _pack_counts(n: np.ndarray) -> bytes:
    """One byte a count; counts of 255 and more follow in eight."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def _unpack_counts(raw: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, "<i8", offset=size)
    return n


def _sent(chunks: DataFrame, shares: int) -> DataFrame:
    """share, chunk, kind (1 word, 2 pair), keys and training counts of each chunk."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                chunk = _Chunk(row)
                trained = chunk.trained()
                pairs, at = chunk.pairs()
                words = len(chunk.hashes)
                sets = (
                    (1, chunk.hashes, np.bincount(chunk.words[trained], minlength=words)),
                    (2, _pair_keys(chunk.hashes[pairs // words], chunk.hashes[pairs % words]), np.bincount(at[trained], minlength=len(pairs))),
                )
                for kind, keys, n in sets:
                    order, share = _dealt(keys, shares)
                    begins = np.flatnonzero(np.diff(share, prepend=-1))
                    for begin, end in zip(begins, np.append(begins[1:], len(share)), strict=True):
                        mine = order[begin:end]
                        columns = {"share": int(share[begin]), "chunk": row["chunk"], "kind": kind, "size": len(mine), "keys": _pack_keys(keys[mine]), "n": _pack_counts(n[mine])}
                        yield pa.RecordBatch.from_pydict({c: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for c, v in columns.items()})

    return chunks.select("chunk", "train", "ends", "words", "hashes").mapInArrow(send, "share long, chunk long, kind long, size long, keys binary, n binary")


def _added(group: pd.DataFrame) -> pd.DataFrame:
    """Totals of one share: to each chunk, which of the keys that it sent other chunks hold too, as bits, and their totals; to chunk -1, sums over all keys."""
    out, share = [], int(group["share"].iloc[0])
    for kind, rows in group.groupby("kind"):
        keys = [_unpack_keys(k) for k in rows["keys"]]
        n = [_unpack_counts(c, s) for c, s in zip(rows["n"], rows["size"], strict=True)]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(n), minlength=len(known)).astype(np.int64)
        shared = np.bincount(at, minlength=len(known)) > 1
        out.append((-1, share, kind, b"", b"", int(total.sum()), int((total > 0).sum())))
        end = 0
        for chunk, size in zip(rows["chunk"], rows["size"], strict=True):
            which = at[end : end + size]
            end += size
            also = shared[which]
            if also.any():
                out.append((chunk, share, kind, np.packbits(also).tobytes(), _pack_counts(total[which[also]]), 0, 0))
    return pd.DataFrame(out, columns=["chunk", "share", "kind", "also", "total", "seen", "different"])


def _walk(row: dict, shares: int, seen_words: int, distinct: int, weight: float) -> dict[str, np.ndarray]:
    """Scores of a chunk's documents from its own counts and the answers it got."""
    chunk = _Chunk(row)
    trained = chunk.trained()
    words = len(chunk.hashes)
    pairs, at = chunk.pairs()
    single = np.bincount(chunk.words[trained], minlength=words)
    double = np.bincount(at[trained], minlength=len(pairs))
    for kind, keys, counts in ((1, chunk.hashes, single), (2, _pair_keys(chunk.hashes[pairs // words], chunk.hashes[pairs % words]), double)):
        order, share = _dealt(keys, shares)
        for a in row["answers"] or []:
            if a["kind"] == kind:
                begin, end = np.searchsorted(share, np.array([a["share"], a["share"] + 1], np.int32))
                mine = order[begin:end]
                also = mine[np.unpackbits(np.frombuffer(a["also"], np.uint8), count=len(mine)).astype(bool)]
                counts[also] = _unpack_counts(a["total"], len(also))
    # A word is a context as often as it occurs: the end token stands before the first word of each text.
    root = (single + 0.5) / (seen_words + 0.5 * (distinct + 1))
    context = single[pairs // words]
    failure = np.where(context > 0, 1 - weight, 1.0) * root[pairs % words]
    arc = np.log10(np.where(double > 0, weight * double / np.maximum(context, 1), 0.0) + failure)
    starts = np.concatenate(([0], chunk.ends[:-1])).astype(np.int64)
    add = lambda per_token: np.add.reduceat(per_token, starts) if len(starts) else per_token
    return {"held_out": ~chunk.train, "n_tokens": np.diff(chunk.ends, prepend=0), "n_known": add((single > 0)[chunk.words].astype(np.int64)), "base_score": add(np.log10(root)[chunk.words]), "score": add(arc[at])}


def lm_scores(docs: DataFrame, weight: float = 0.3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Training documents are those whose crc32(doc_id as text) mod 5 is not 1 (a
    null id counts as ''). Null and empty texts are one end token. Repeated
    rows train and are scored as often as they occur; without a training row
    every token is unknown; an empty table gives no rows. Words and pairs are
    told apart by 64-bit hashes.
    """
    chunks = _encode(docs.select("doc_id", "text"))
    tokens = chunks.agg(F.sum(F.length("words") / 4)).first()[0] or 0
    shares = max(8, math.ceil(tokens / SHARE_KEYS))
    totals = _sent(chunks, shares).groupBy("share").applyInPandas(_added, "chunk long, share long, kind long, also binary, total binary, seen long, different long")
    answers = stored(totals, "answers", compression="zstd")
    sums = answers.where("chunk = -1 and kind = 1").agg(F.sum("seen"), F.sum("different")).first()
    seen, distinct = (int(x or 0) for x in sums)
    mine = answers.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("share", "kind", "also", "total")).alias("answers"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in _rows(batch):
                scores = _walk(row, shares, seen, distinct, weight)
                columns = {"doc_id": pa.array(row["ids"], id_type), **{k: pa.array(v) for k, v in scores.items()}}
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = chunks.join(mine, "chunk", "left").mapInArrow(walked, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(seen).cast("long").alias("train_tokens"), "base_score", "score")
