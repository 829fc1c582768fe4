"""Mixture-controlled packing of tokenised documents into fixed-length sequences.

Each source is a queue of tokens. The stream of packed tokens is a row of
windows, and in window j a source is served its quantum plus the deficit it
carries: with cumulative entitlement E(j) (a real number) it has been served
floor(E(j)) tokens after window j, and the fraction is the deficit carried
into the next. A queue that runs dry leaves the round, and the others' quanta
grow. So the place of every token follows from its rank in its queue, in all
partitions at once; documents are cut where a quantum or a sequence ends, and
only the last sequence has padding.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

SEQUENCE = 2048
END_ID = 1
#: Words that a generation of a worker's cache may hold.
_GENERATION = 100_000
_PIECE_BYTES = 1 << 20
#: Lower-case letters that are one character in normal form C; a word of them is one pre-token.
_PLAIN = re.compile("[a-zà-öø-ÿ]+")
#: Fixed rule of byte-level vocabularies: a byte that is no printable Latin-1 sign is written as the next sign from 256.
_BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """The library's ids of whole texts, found once for each word between ASCII white space.

    The vocabulary's pre-tokens never span white space and its lower-casing
    is per character, so the ids of a text are its words' ids in a row. Texts
    that hold a special token's string in any case go to the library whole:
    there, only the exact string is the special token. What is learned is held
    in two generations of bounded size; a word of the old one that is met
    again moves to the young one.
    """

    def __init__(self, path: str, generation: int = _GENERATION) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)", re.IGNORECASE)
        self.generation = generation
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.model = self.library.model
        sample = ["the", "straße", "été", "zzxqy"]
        self.direct = [self._plain(w) for w in sample] == [self.library.encode(w, add_special_tokens=False).ids for w in sample]

    def _plain(self, word: str) -> list[int]:
        """The ids of a word that is one pre-token and that normalising leaves as it is."""
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_SIGNS))]

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)

    def _alone(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words: of lower-case Latin ones from the library's model, of the others from one call of the library."""
        texts = [(w, w.decode("utf-8", "replace")) for w in words]
        plain = [(w, t) for w, t in texts if self.direct and _PLAIN.fullmatch(t)]
        known = {w: self._packed(self._plain(t)) for w, t in plain}
        if others := [(w, t) for w, t in texts if w not in known]:
            found = self.library.encode([t for _, t in others], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, self.kind).tobytes()
            ends = (np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(others) + 1)) * self.kind.itemsize).tolist()
            known |= {w: raw[ends[k] : ends[k + 1]] for k, (w, _) in enumerate(others)}
        return known

    def _learn(self, new: set[bytes]) -> None:
        """Put words in the young generation: one that ends in ASCII marks after an ASCII letter, where a pre-token ends too, as the two parts' ids in a row."""
        if len(self.young) + len(new) > self.generation:
            self.old, self.young = self.young, {}
        old, halves, kept = self.old.get, {}, {}
        for word in new:
            core = word.rstrip(_MARKS)
            if len(core) < len(word) and core and core[-1:].islower():
                halves[word] = core, word[len(core) :]
            elif (ids := old(word)) is not None:
                kept[word] = ids
        parts = {p for pair in halves.values() for p in pair}
        known = {p: ids for p in parts if (ids := self.young.get(p) or old(p)) is not None} | kept
        known |= self._alone(list((parts | (new - halves.keys())) - known.keys()))
        self.young.update(known)
        self.young.update((w, known[a] + known[b]) for w, (a, b) in halves.items())

    def forget(self) -> None:
        """Give back the memory of what was learned."""
        self.young, self.old = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        split: list = [None if self.special.search(t) else t.encode("utf-8", "replace").lower().split() for t in texts]
        get = self.young.get
        ids = [None if words is None else list(map(get, words)) for words in split]
        gaps = {k: [i for i, x in enumerate(found) if x is None] for k, found in enumerate(ids) if found is not None and None in found}
        if gaps:
            self._learn({split[k][i] for k, at in gaps.items() for i in at})
            for k, at in gaps.items():
                words, found, get = split[k], ids[k], self.young.__getitem__
                for i in at:
                    found[i] = get(words[i])
        return [b"".join(found) if found is not None else self._packed(self.library.encode(t, add_special_tokens=False).ids) for t, found in zip(texts, ids, strict=True)]


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def shared_tokenizer(path: str, generation: int = _GENERATION) -> WordTokenizer:
    """One tokenizer a worker process, so that what it has learned serves later tasks."""
    if (path, generation) not in _tokenizers:
        _tokenizers[path, generation] = WordTokenizer(path, generation)
    return _tokenizers[path, generation]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, keep_words: bool = True, generation: int = _GENERATION) -> DataFrame:
    """doc_id, queue, part, before, n, ids: each document's ids and its place in its queue's share of a part.

    The rows are written to the shared folder, which fixes parts and places.
    Workers keep the words they have learned for later tasks unless
    ``keep_words`` is off, which leaves more memory to what runs next;
    ``generation`` is how many words each half of a worker's cache may hold.
    """
    schema = docs.select("doc_id").schema
    out_type = f"doc_id {schema['doc_id'].dataType.simpleString()}, queue string, part long, before long, n long, ids binary"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared_tokenizer(path, generation)
        end, width = np.array([end_id], tokenizer.kind).tobytes(), tokenizer.kind.itemsize
        part, served = TaskContext.get().partitionId(), {}

        def finish(ids: list, queues: list, texts: list) -> pa.RecordBatch:
            raw = [r + end for r in tokenizer.encode(texts)]
            sizes = [len(r) // width for r in raw]
            before = []
            for q, n in zip(queues, sizes, strict=True):
                before.append(served.get(q, 0))
                served[q] = before[-1] + n
            columns = [pa.array(ids, batch.schema.field("doc_id").type), pa.array(queues, pa.string()), pa.array([part] * len(raw), pa.int64()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "queue", "part", "before", "n", "ids"])

        for batch in batches:
            ids, queues, texts = (batch.column(c).to_pylist() for c in ("doc_id", "queue", "text"))
            at = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= _PIECE_BYTES:
                    yield finish(ids[at : i + 1], queues[at : i + 1], texts[at : i + 1])
                    at, size = i + 1, 0
            if at < len(texts):
                yield finish(ids[at:], queues[at:], texts[at:])
        if not keep_words:
            tokenizer.forget()

    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("queue"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(encoded, out_type), "tokens")


@dataclass
class Quanta:
    """Cumulative entitlements: between knots (times in tokens) every queue is served at a constant rate."""

    totals: list[int]
    knots: list[float]
    served: list[list[float]]  # by queue, at each knot
    window: int

    @classmethod
    def of(cls, totals: list[int], weights: list[float], window: int) -> Quanta:
        time, done, left = 0.0, [0.0] * len(totals), {i for i, t in enumerate(totals) if t}
        knots, served = [0.0], [[0.0] for _ in totals]
        while left:
            weight = sum(weights[i] for i in left)
            spans = {i: (totals[i] - done[i]) * weight / weights[i] for i in left}
            span = min(spans.values())
            dry = {i for i in left if spans[i] <= span * (1 + 1e-12)}
            for i in left:
                done[i] = float(totals[i]) if i in dry else done[i] + span * weights[i] / weight
            time, left = time + span, left - dry
            knots.append(time)
            for i, s in enumerate(served):
                s.append(done[i])
        return cls(totals, knots, served, window)

    @property
    def windows(self) -> int:
        return max(1, int(np.ceil(self.knots[-1] / self.window)))

    def after(self, queue: int, windows: np.ndarray) -> np.ndarray:
        """Tokens of the queue that lie in the first windows: the entitlement rounded down, all of them after the last."""
        exact = np.floor(np.interp(windows * float(self.window), self.knots, self.served[queue]) + 1e-6).astype(np.int64)
        return np.where(windows >= self.windows, self.totals[queue], np.minimum(exact, self.totals[queue]))

    def places(self, queue: int, window: np.ndarray) -> np.ndarray:
        """Where in the packed stream the queue's share of each window begins."""
        before = sum(self.after(q, window) for q in range(len(self.totals)))
        return before + sum((self.after(q, window + 1) - self.after(q, window) for q in range(queue)), np.zeros(len(window), np.int64))


def _pieces(quanta: Quanta, queue: int, first: int, n: int, sequence: int, shares: dict) -> list[tuple[int, int, int]]:
    """(start, length, stream position) of each piece of a document of ``n`` tokens from rank ``first`` of its queue."""
    if queue not in shares:  # the windows' shares of this queue, a stretch at a time
        shares[queue] = [0, np.zeros(1, np.int64), np.zeros(0, np.int64)]
    low, ends, places = shares[queue]
    if not (len(places) and ends[0] <= first and first + n <= ends[-1]):
        guess, until = (int(w) for w in np.interp([first, first + n], quanta.served[queue], quanta.knots) / quanta.window)
        reach = until - guess + 64
        lo, hi = max(0, guess - 64), min(quanta.windows, guess + reach)
        while lo and quanta.after(queue, np.array([lo]))[0] > first:
            lo = max(0, lo - reach)
            reach *= 2
        while hi < quanta.windows and quanta.after(queue, np.array([hi]))[0] < first + n:
            hi = min(quanta.windows, hi + reach)
            reach *= 2
        ends, places = quanta.after(queue, np.arange(lo, hi + 1)), quanta.places(queue, np.arange(lo, hi))
        shares[queue] = [lo, ends, places]
    out, at = [], first
    k = int(np.searchsorted(ends, first, side="right")) - 1
    while at < first + n:
        while ends[k + 1] <= at:
            k += 1
        place = int(places[k]) + at - int(ends[k])
        length = min(first + n - at, int(ends[k + 1]) - at, sequence - place % sequence)
        out.append((at - first, length, place))
        at += length
    return out


def packed(docs: DataFrame, path: str | None = None, weights: dict[str, float] | None = None, sequence: int = SEQUENCE, window_sequences: int = 64, temperature: float = 1.0, keep_words: bool = True, generation: int = _GENERATION) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``weights`` are the sources' target token proportions; without any they
    are the sources' numbers of tokens to the power ``temperature`` (at 1 all
    queues run dry together). A source without a weight gets the smallest. Null and empty texts are one
    end token; a null source counts as ''. Repeated rows are packed as often
    as they occur; an empty table gives no rows. The driver sees one row a
    source (its total).
    """
    tokens = tokenized(docs, path or tokenizer_path(), keep_words=keep_words, generation=generation)
    kind = shared_tokenizer(path or tokenizer_path()).kind.str
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(parts.select("queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), "n"), "offsets")
    totals = {r["queue"]: r["n"] for r in offsets.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()}
    least = min(weights.values()) if weights else 1.0
    quanta = Quanta.of(list(totals.values()), [weights.get(q, least) for q in totals] if weights else [float(t) ** temperature for t in totals.values()], sequence * window_sequences)
    number = {q: i for i, q in enumerate(totals)}
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict = {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("doc_id", "queue", "first", "n")}
            out: list[list] = [[] for _ in range(8)]
            for doc, queue, first, n, raw in zip(*columns.values(), batch.column("ids"), strict=True):
                wide = np.frombuffer(raw.as_buffer(), kind).astype("<u4")
                for start, length, place in _pieces(quanta, number[queue], first, n, sequence, shares):
                    crc = zlib.crc32(wide[start : start + length])
                    for column, value in zip(out, (doc, start, length, crc, n, place // sequence, place % sequence, queue), strict=True):
                        column.append(value)
            kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    ranked = tokens.join(offsets.drop("n"), ["queue", "part"]).select("doc_id", "queue", (F.col("offset") + F.col("before")).alias("first"), "n", "ids")
    return ranked.mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
