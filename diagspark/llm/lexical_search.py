"""Ranked lexical search of all documents for a set of items by two trees.

Items and documents are sparse vectors: an item has a weight for each of its
terms, a document an impact. Both sides get a hierarchy whose nodes hold the
maxima of their coordinates. The product of two nodes' maxima bounds every
score between them, so a pair of nodes whose bound is below the weakest kth
score of its items is left out whole; pairs of leaves are scored exactly.

Trees of documents are built for a batch of rows in the task that reads it.
The kth scores of a part of the documents (found first, by the same search) are
lower bounds of the final ones, so that all tasks prune from the start; they
change nothing in the result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import stored

K = 50
#: (item, term) pairs of a block of items, in the mean; a block is held by the driver and sent to every executor.
BLOCK_TERMS = 1 << 16
#: One document in so many gives the first lower bounds.
SEEDS = 32
LEAF_ITEMS, LEAF_DOCUMENTS, BATCH_DOCUMENTS = 8, 64, 4096
#: Bytes as they count in terms: letters in lower case, digits and all but ASCII as they are, the rest white.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What a term counts in a document, for ``tf`` occurrences in a text of ``length`` terms."""
    m = 50 + 50 * length * documents // all_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass
class Sparse:
    """Rows of non-negative numbers by coordinate."""

    n: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray


@dataclass
class Node:
    members: np.ndarray
    entries: Sparse | None = None  # of a leaf; rows are places in ``members``
    children: list[Node] = field(default_factory=list)
    columns: np.ndarray | None = None  # coordinates that are not 0, and their maxima
    maxima: np.ndarray | None = None


def hierarchy(vectors: Sparse, weights: np.ndarray, leaf: int) -> Node:
    """A tree of the rows: each node is parted by having or not having the coordinate that parts it most evenly, weighted."""
    width = len(weights)

    def grow(members: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> Node:
        n = len(members)
        if n <= leaf:
            node = Node(members, Sparse(n, row, column, value))
            dense = np.zeros(width)
            np.maximum.at(dense, column, value)
        else:
            held = np.bincount(column, minlength=width)
            evenness = np.minimum(held, n - held) * weights
            best = int(np.argmax(evenness))
            has = np.zeros(n, bool)
            if evenness[best] > 0:
                has[row[column == best]] = True
            else:
                has[: n // 2] = True
            node = Node(members)
            dense = np.zeros(width)
            for side in (has, ~has):
                place, mine = np.cumsum(side) - 1, side[row]
                child = grow(members[side], place[row[mine]], column[mine], value[mine])
                node.children.append(child)
                dense[child.columns] = np.maximum(dense[child.columns], child.maxima)
        node.columns = np.flatnonzero(dense)
        node.maxima = dense[node.columns]
        return node

    return grow(np.arange(vectors.n), vectors.row, vectors.column, vectors.value)


class Search:
    """The best documents of each item, over any number of trees of documents."""

    def __init__(self, items: Sparse, weights: np.ndarray, k: int, least: np.ndarray) -> None:
        self.k, self.tree = k, hierarchy(items, weights, LEAF_ITEMS)
        self.best: list[list[tuple]] = [[] for _ in range(items.n)]  # heaps of (score, -doc_id)
        self.weakest = np.maximum(least, 1)  # by item: a score that a document needs at least
        self.dense = np.zeros(len(weights))
        self.place = np.full(len(weights), -1)
        self.pairs = self.scored = 0

    def bound(self, items: Node, documents: Node) -> float:
        """No score between the two is greater. Whole numbers below 2**53 are exact."""
        self.dense[documents.columns] = documents.maxima
        bound = float(items.maxima @ self.dense[items.columns])
        self.dense[documents.columns] = 0
        return bound

    def add(self, documents: Sparse, ids: list, weights: np.ndarray) -> None:
        stack = [(math.inf, self.tree, hierarchy(documents, weights, LEAF_DOCUMENTS))]
        while stack:
            bound, items, docs = stack.pop()
            self.pairs += 1
            if bound < self.weakest[items.members].min():
                continue
            if not items.children and not docs.children:
                self.score(items, docs, ids)
                continue
            found = [(self.bound(i, d), i, d) for i in items.children or [items] for d in docs.children or [docs]]
            stack += sorted(found, key=lambda x: x[0])  # the most promising pair comes next

    def score(self, items: Node, docs: Node, ids: list) -> None:
        """All pairs of two leaves, exactly."""
        self.scored += 1
        self.place[items.columns] = np.arange(len(items.columns))
        weights = np.zeros((len(items.members), len(items.columns)))
        weights[items.entries.row, self.place[items.entries.column]] = items.entries.value
        at = self.place[docs.entries.column]
        mine = at >= 0
        values = np.zeros((len(docs.members), len(items.columns)))
        values[docs.entries.row[mine], at[mine]] = docs.entries.value[mine]
        self.place[items.columns] = -1
        scores = weights @ values.T
        for item, row in zip(items.members.tolist(), scores, strict=True):
            heap = self.best[item]
            for j in np.flatnonzero(row >= self.weakest[item]).tolist():
                doc = ids[docs.members[j]]
                entry = (int(row[j]), -math.inf if doc is None else -doc)
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.weakest[item] = max(self.weakest[item], heap[0][0])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the terms of each item, once each."""
    kind = items.schema["item_id"].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), pa.array([t for ts in terms for t in ts], pa.binary())], ["item_id", "term"])

    texts = items.where("text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    return stored(texts.mapInArrow(split, f"item_id {kind.simpleString()}, term binary").distinct(), "item-terms")


def _lists(values: list | np.ndarray, ends: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of each document with a term, and a row with a null n from each task: in how many documents it has met each term.

    ``n`` counts all terms of a text; only those of the vocabulary are listed.
    """
    kind = docs.schema["doc_id"].dataType
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, names = known.value.get, ["doc_id", "n", "terms", "tfs"]
        holding = np.zeros(len(known.value), np.int64)
        for batch in batches:
            rows, lengths, terms, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column("text")):
                words = terms_of(text.as_buffer().to_pybytes())
                if words:
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    rows.append(i)
                    lengths.append(len(words))
                    terms.extend(found.keys())
                    tfs.extend(found.values())
                    ends.append(len(terms))
            holding += np.bincount(np.array(terms, np.int64), minlength=len(holding))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), _lists(terms, ends), _lists(tfs, ends)], names)
        met = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, to_arrow_type(kind)), pa.nulls(1, pa.int64()), _lists(met, [0, len(met)]), _lists(holding[met], [0, len(met)])], names)

    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    return stored(texts.mapInArrow(counted, f"doc_id {kind.simpleString()}, n long, terms array<int>, tfs array<int>"), "term-vectors")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(docs: DataFrame, search: object, item_kind: object) -> DataFrame:
    """item_id, doc_id, score: what each task's search keeps. ``search`` is a broadcast of all that it needs."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, item_ids, weights, least, k, documents, all_terms = search.value
        at = Search(items, weights, k, least)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_DOCUMENTS):
                batch = whole.slice(start, BATCH_DOCUMENTS)
                n, terms, tfs = (batch.column(c) for c in ("n", "terms", "tfs"))
                sizes = np.diff(terms.offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), sizes)
                value = impacts(tfs.flatten().to_numpy().astype(np.int64), n.to_numpy()[row], documents, all_terms)
                at.add(Sparse(len(n), row, terms.flatten().to_numpy(), value), batch.column("doc_id").to_pylist(), weights)
        kept = [(item_ids[i], None if d == -math.inf else -d, s) for i, heap in enumerate(at.best) for s, d in heap]
        columns = list(zip(*kept, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], to_arrow_type(item_kind)), pa.array(columns[1], to_arrow_type(kind)), pa.array(columns[2], pa.int64())], ["item_id", "doc_id", "score"])

    return docs.select("doc_id", "n", "terms", "tfs").mapInArrow(run, f"item_id {item_kind.simpleString()}, doc_id {kind.simpleString()}, score long")


def _block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame | None:
    """The ranks of one block of items, whose terms the driver holds."""
    spark, kind = docs.sparkSession, pairs.schema["item_id"].dataType
    rows = pairs.orderBy(F.asc_nulls_last("item_id"), "term").collect()
    if not rows:
        return None
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    number = {i: n for n, i in enumerate(dict.fromkeys(r["item_id"] for r in rows))}
    table = vectors(docs, vocabulary)
    texts = table.where("n is not null")
    total = texts.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    if not total["documents"]:
        return None
    held = table.where("n is null").select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.tfs").alias("n")).collect()
    holding = {r["terms"]: r["n"] for r in held}
    weights = np.array([weight(total["documents"], holding.get(t, 0)) for t in range(len(vocabulary))], float)
    column = np.array([vocabulary[bytes(r["term"])] for r in rows])
    items = Sparse(len(number), np.array([number[r["item_id"]] for r in rows]), column, weights[column])

    def search(least: np.ndarray) -> object:
        return spark.sparkContext.broadcast((items, list(number), weights, least, k, total["documents"], total["terms"]))

    part = texts.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEEDS)) == 0)
    seeds = _best(_searched(part, search(np.zeros(len(number))), kind), k)
    least = np.zeros(len(number))
    for r in seeds.groupBy("item_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect():
        least[number[r["item_id"]]] = r["least"]
    return _best(_searched(texts, search(least), kind), k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 of each item.

    Every row of ``docs`` with a term is a document, repeated rows too; equal
    scores rank by doc_id, nulls last. Null and empty texts hold no term. Rows
    of ``items`` with one id, null included, are one item with the terms of
    all; an item without a term, or that no document shares a term with, has no rows. Ids
    of documents are whole numbers. Other columns are ignored.
    """
    pairs = item_terms(items)
    n = pairs.count()
    blocks = -(-n // block_terms)
    found = [r for b in range(blocks) if (r := _block(docs, pairs.where(_block_of(blocks) == b), k)) is not None]
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long, rank int"
    whole = found[0] if found else docs.sparkSession.createDataFrame([], kinds)
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(blocks))


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}')"
ORACLE_SQL = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT * FROM split WHERE len(terms) > 0),
total AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM docs),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
items AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark WHERE text IS NOT NULL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM counts, total GROUP BY term),
lengths AS (SELECT r, doc_id, 50 + (50 * len(terms) * n) // l AS m FROM docs, total),
scores AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY item_id, r, doc_id),
ranks AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS "rank", doc_id, score
    FROM scores WHERE score > 0)
SELECT * FROM ranks WHERE "rank" <= 50
"""
