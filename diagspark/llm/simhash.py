"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits differ in at most
four of their eight bytes, so at least four positional bytes are equal. The
index posts every fingerprint under sets of positional bytes chosen so that
any four equal positions contain one of the sets whole. Fingerprints of one
posting list are compared: their equal positional bytes are tallied, pairs
that reach four are verified bit by bit.

Texts of a Jaccard similarity of 0.8 differ in some ten of 64 bits. For those
(``similar_links``) the same index holds 256 bits, as four fingerprints of
five-word shingles: texts meet where a fingerprint has two equal bytes, pairs
within a wide radius are candidates, and the similarity of their shingle sets
decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored, whole
from .graph import components

BYTES = 8
#: Rows of one posting list that are compared in one place; larger lists are split in blocks.
BLOCK_ROWS = 4096
#: Rows of a posting list that are all paired, of fingerprints and of similar texts.
_WIDE_GROUP, _FEW = 64, 4
_BITS_AT_ONCE = 1 << 15

#: The rule for similar texts: words of a shingle and the least Jaccard similarity of two texts' sets, in fifths.
SIMILAR_SHINGLE, SIMILAR_FIFTHS = 5, 4
#: Fingerprints of a text in that index, the radius in two and in all of them, and how many candidates of a text a long list gives at first, nearest first, and how many of a text are checked at first.
PRINTS, RADIUS_TWO, RADIUS_ALL, NEAREST, CHECKED = 4, 28, 68, 1, 8
_PAIRS = list(combinations(range(BYTES), 2))
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _shingles_of(text: str | None, sizes: tuple[int, ...], seed: int) -> tuple[bytes, list[np.ndarray]]:
    """The lower-case words of a whole text with single spaces, and for each size the hash of every shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return b"", [np.zeros(0, np.uint64) for _ in sizes]
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    found = []
    for shingle in sizes:
        last = min(shingle, len(words)) - 1
        spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
        found.append(np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - last))
    return joined, found


def _shingles(text: str | None, shingle: int, seed: int) -> tuple[bytes, np.ndarray]:
    joined, found = _shingles_of(text, (shingle,), seed)
    return joined, found[0]


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        part = hashes[at : at + _BITS_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 if it has no word."""
    return _majority(_shingles(text, shingle, seed)[1])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of every whole text as a long (the same 64 bits)."""

    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([simhash(t) for t in batch], np.uint64).astype(np.int64))

    return docs.withColumn(name, fingerprint(whole(text)))


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions of which any four positions contain one whole.

    Width 2: the pairs inside three groups of positions (two of any four
    positions share a group); width 3: triples inside a group or with two in
    a group and one in the next; width 4: all.
    """
    group = (0, 0, 0, 1, 1, 1, 2, 2)
    if width == 2:
        return [s for s in combinations(range(BYTES), 2) if len({group[p] for p in s}) == 1]
    if width == 3:
        found = []
        for s in combinations(range(BYTES), 3):
            kinds = [group[p] for p in s]
            twice = next((k for k in kinds if kinds.count(k) == 2), None)
            if len(set(kinds)) == 1 or twice is not None and (twice + 1) % 3 in kinds:
                found.append(s)
        return found
    return list(combinations(range(BYTES), 4))


def _width(count: int) -> int:
    """The narrowest index whose posting lists hold some dozens of unlike fingerprints each on average."""
    return next((w for w in (2, 3) if count <= 64 * 256**w), 4)


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs share enough positional bytes (the count filter) and differ in at most ``bits`` bits."""
    x = a ^ b
    same = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = np.flatnonzero(same >= BYTES - bits)
    return near[np.bitwise_count(x[near]) <= bits]


def _forest(fp: np.ndarray, side: np.ndarray, crossed: bool, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span a large posting list: of each row, one to every group that the rows before it formed."""
    label, left, right = np.arange(len(fp)), [], []
    for i in range(1, len(fp)):
        near = _close(np.full(i, fp[i]), fp[:i], bits)
        if crossed:
            near = near[side[near] != side[i]]
        if len(near):
            groups, first = np.unique(label[near], return_index=True)
            left.append(np.full(len(groups), fp[i]))
            right.append(fp[near[first]])
            low = min(int(groups[0]), i)
            label[: i + 1][np.isin(label[: i + 1], groups)] = low
            label[i] = low
    return left, right


def _links_of(rows: dict[str, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole posting lists that lie one after the other."""
    fp, side, starts = rows["fp"], rows["side"], np.flatnonzero(rows["new"])
    sizes = np.diff(np.append(starts, len(fp)))
    crossed = np.repeat(rows["crossed"][starts], sizes)
    last = np.repeat(starts + sizes, sizes)
    left, right = [], []
    small = np.repeat(sizes <= _WIDE_GROUP, sizes)
    for shift in range(1, min(int(sizes.max(initial=0)), _WIDE_GROUP + 1)):
        i = np.flatnonzero(small[: len(fp) - shift] & (np.arange(len(fp) - shift) + shift < last[: len(fp) - shift]))
        i = i[~crossed[i] | (side[i] != side[i + shift])]
        near = i[_close(fp[i], fp[i + shift], bits)]
        left.append(fp[near])
        right.append(fp[near + shift])
    for at, size in zip(starts[sizes > _WIDE_GROUP], sizes[sizes > _WIDE_GROUP], strict=True):
        a, b = _forest(fp[at : at + size], side[at : at + size], bool(crossed[at]), bits)
        left += a
        right += b
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _by_place(place: list[str], names: tuple[str, ...], links_of: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, ...]], out: tuple[str, ...] = ("a", "b")) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives whole posting lists, which lie one after the other, to ``links_of``."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(batch: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [batch.column(c).to_numpy() for c in place]
            change = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))[: batch.num_rows]
            rows = {c: batch.column(c).to_numpy() for c in (*names, "side")} | {"new": change, "crossed": columns[2] != columns[3]}
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links_of(rows)], list(out))

        for batch in batches:
            if not batch.num_rows:
                continue
            whole_batch = pa.Table.from_batches([*held, batch])
            columns = [whole_batch.column(c).to_numpy() for c in place]
            differs = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
            cut = int(differs[-1]) + 1 if len(differs) else 0  # the last list may go on in the next batch
            if cut:
                yield from finish(whole_batch.slice(0, cut))
            held = whole_batch.slice(cut).to_batches()
        if held:
            yield from finish(pa.Table.from_batches(held))

    return compared


def near_links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """a, b: links between distinct fingerprints of column ``fp`` at ``bits`` (4 at most) or fewer differing bits.

    Every link is in the result, but for lists of over 64 rows only as many
    as connect what is linked there. A list of over BLOCK_ROWS rows is split
    in blocks, each pair of blocks being compared in a place of its own, so no
    list has to fit in one task.
    """
    if bits > 4:
        raise ValueError("the index guarantees links of up to 4 bits")
    masks = [sum(0xFF << (8 * p) for p in s) for s in position_sets(_width(nodes.count()))]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    posted = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.list", "k.key")
    sizes = posted.groupBy("list", "key").count().where("count > 1")
    sized = posted.join(stored(sizes, "posting-sizes"), ["list", "key"])
    blocks = F.ceil(F.col("count") / BLOCK_ROWS).cast("int")
    mine = sized.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    dealt = mine.select("fp", "list", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = dealt.select("fp", "list", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("side"))
    place = ["list", "key", "low", "high"]

    compared = _by_place(place, ("fp",), lambda rows: tuple(x.view(np.int64) for x in _links_of(rows | {"fp": rows["fp"].view(np.uint64)}, bits)))
    found = placed.repartition(*place).sortWithinPartitions(*place).mapInArrow(compared, "a long, b long")
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(marked: DataFrame, bits: int = 4) -> DataFrame:
    """fp, component (a fingerprint) of every distinct fingerprint of ``marked``."""
    nodes = stored(marked.select("fp").distinct(), "nodes")
    linked = components(near_links(nodes, bits), "a", "b")
    joined = nodes.join(linked, nodes["fp"] == linked["node"], "left")
    return stored(joined.select("fp", F.coalesce("component", "fp").alias("component")), "components")


def near_duplicates(docs: DataFrame, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    component_id is the smallest doc_id that links reach, its own included;
    null ids are passed over, and it is null only where all ids of a component
    are. Null, empty and blank texts have fingerprint 0, which links like any
    other. Repeated rows give repeated rows; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classed = stored(near_classes(marked, bits).join(least, "fp"), "classes")
    ids = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(classed.join(ids, "component").select("fp", "component_id"), "component-ids")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", text, "component_id")


def without_near_duplicates(docs: DataFrame, bits: int = 4) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of the smallest doc_id.

    Ids that are null come last; rows without an id are told apart by their
    text. Of repeated rows of one id one stays, that of the smallest text.
    """
    light = fingerprints(docs.select("doc_id", "text")).select("doc_id", _key().alias("key"), "fp")
    marked = stored(light, "fingerprints")
    return _first_rows(docs, marked, "fp", near_classes(marked, bits))


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(whole("text"), 256)))


def _first_rows(docs: DataFrame, marked: DataFrame, node: str, classed: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each component of nodes."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key", node)
    first = marked.groupBy(node).agg(F.min(order).alias("first"))
    least = classed.join(first, node).groupBy("component").agg(F.min("first").alias("first"))
    kept = stored(least.select("first.key").distinct(), "kept")
    keyed = docs.select(F.struct("*").alias("row"), _key().alias("key"), F.xxhash64("text").alias("order"), F.col("doc_id").isNull().alias("unnamed"))
    # Rows without an id may all be one text: what each task has of them is made one row first.
    unnamed = keyed.where("unnamed").withColumn("part", F.spark_partition_id()).dropDuplicates(["key", "part"]).drop("part")
    chosen = keyed.where("not unnamed").union(unnamed).join(kept, "key", "left_semi")
    one = Window.partitionBy("key").orderBy("order")
    return chosen.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp, node (a hash of the words), p0.. (fingerprints of the set of shingles) of every row.

    One function gives ``fp`` (see ``fingerprints``) and the others: two would
    be two Python workers a task, each with its own copy of the texts.
    """
    import xxhash

    names = ["fp", "node", *(f"p{i}" for i in range(PRINTS))]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = np.zeros((len(batch), len(names)), np.uint64)
            for row, text in zip(rows, batch, strict=True):
                joined, (plain, hashes) = _shingles_of(text, (4, SIMILAR_SHINGLE), 42)
                hashes = np.unique(hashes)
                row[0], row[1], row[2] = _majority(plain), xxhash.xxh64_intdigest(joined, 42), _majority(hashes)
                for i, factor in enumerate(_MIX):
                    mixed = hashes * np.uint64(factor)
                    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(_MIX[0])
                    row[i + 3] = _majority(mixed ^ (mixed >> np.uint64(29)))
            yield pd.DataFrame(rows.view(np.int64), columns=names)

    return docs.select("doc_id", _key().alias("key"), sketch(whole("text")).alias("s")).select("doc_id", "key", "s.*")


def _similar_of(rows: dict[str, np.ndarray], nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates inside whole posting lists: pairs within RADIUS_TWO that have no earlier list of the same fingerprint in common.

    In lists of over _FEW rows these are the ``nearest`` ones of each
    row, with whether it had more.
    """
    node, side, starts = rows["node"], rows["side"], np.flatnonzero(rows["new"])
    own, more = rows["own"].view(np.uint64), rows["more"].view(np.uint64)
    below = np.array([[p < s[1] for p in range(BYTES)] for s in _PAIRS])[rows["list"] % len(_PAIRS)]
    sizes = np.diff(np.append(starts, len(node)))
    crossed = np.repeat(rows["crossed"][starts], sizes)
    last = np.repeat(starts + sizes, sizes)
    left, right, cut = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]

    def first_met(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same = (own[i] ^ own[j]).view(np.uint8).reshape(-1, BYTES) == 0
        return (same & below[i]).sum(axis=1) == 1

    small = np.repeat(sizes <= _FEW, sizes)
    for shift in range(1, min(int(sizes.max(initial=0)), _FEW + 1)):
        i = np.flatnonzero(small[: len(node) - shift] & (np.arange(len(node) - shift) + shift < last[: len(node) - shift]))
        i = i[~crossed[i] | (side[i] != side[i + shift])]
        i = i[np.bitwise_count(own[i] ^ own[i + shift]) + np.bitwise_count(more[i] ^ more[i + shift]) <= RADIUS_TWO]
        i = i[first_met(i, i + shift)]
        for x, y in ((i, i + shift), (i + shift, i)):
            left.append(node[x])
            right.append(node[y])
            cut.append(np.zeros(len(i), bool))
    for at, size in zip(starts[sizes > _FEW], sizes[sizes > _FEW], strict=True):
        here = slice(at, at + size)
        n, o, m, s = node[here], own[here], more[here], side[here]
        for low in range(0, size, 64):
            part = slice(low, low + 64)
            apart = np.bitwise_count(o[part, None] ^ o) + np.bitwise_count(m[part, None] ^ m)
            apart[(n[part, None] == n) | (crossed[at] & (s[part, None] == s))] = 255
            i, j = np.nonzero(apart <= RADIUS_TWO)
            met = first_met(at + low + i, at + j)
            i, j = i[met], j[met]
            order = np.lexsort((n[j], apart[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            had_more = np.zeros(len(n[part]), bool)
            had_more[i[rank >= nearest]] = True
            i, j = i[rank < nearest], j[rank < nearest]
            left.append(n[part][i])
            right.append(n[j])
            cut.append(had_more[i])
    return np.concatenate(left), np.concatenate(right), np.concatenate(cut)


def similar_candidates(nodes: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """a, b, more: of each node a, distinct nodes b (node, p0..) that share two bytes of a fingerprint and lie within the radius.

    In long posting lists a node has its ``nearest`` ones only, so a crowd of
    near copies gives no square of pairs; ``more`` says that a has others.
    A pair that is left out has ``more`` for both. Lists of over BLOCK_ROWS
    rows are split in blocks; which lists those are is estimated from one node
    of 16.
    """
    masks = [sum(0xFF << (8 * p) for p in s) for s in _PAIRS]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    prints = F.array(*(F.struct(F.lit(i * len(_PAIRS)).alias("base"), F.col(f"p{i}").alias("own"), F.col(f"p{(i + 1) % PRINTS}").alias("more")) for i in range(PRINTS)))
    keys = F.array(*(F.struct((F.col("base") + i).alias("list"), F.col("own").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    light = ("node", "own", "more")
    each = nodes.select("node", F.explode(prints).alias("p")).select("node", "p.*")
    posted = each.select(*light, F.explode(keys).alias("k")).select(*light, "k.list", "k.key")
    long = posted.where(F.pmod(F.xxhash64("node"), F.lit(16)) == 0).groupBy("list", "key").agg((F.count("*") * 16).alias("count")).where(F.col("count") > BLOCK_ROWS)
    sized = posted.join(stored(long, "long-lists"), ["list", "key"], "left")
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK_ROWS), F.lit(1)).cast("int")
    mine = sized.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = mine.select(*light, "list", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = dealt.select(*light, "list", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("side"))
    place = ["list", "key", "low", "high"]
    compared = _by_place(place, (*light, "list"), lambda rows: _similar_of(rows, nearest), ("a", "b", "more"))
    found = placed.repartition(*place).sortWithinPartitions(*place).mapInArrow(compared, "a long, b long, more boolean")
    # Of each pair one row, with who of the two has met whom: its distance is computed once.
    up, more = F.col("a") < F.col("b"), F.col("more")
    sides = {"met_u": up, "met_v": ~up, "more_u": up & more, "more_v": ~up & more}
    pairs = stored(found.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(*(F.bool_or(c).alias(n) for n, c in sides.items())), "met")
    other = {side: nodes.select(F.col("node").alias(side), *(F.col(f"p{i}").alias(f"{side}{i}") for i in range(PRINTS))) for side in "uv"}
    apart = sum((F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(PRINTS)), F.lit(0))
    close = stored(pairs.join(other["u"], "u").join(other["v"], "v").withColumn("apart", apart).where(F.col("apart") <= RADIUS_ALL).select(*pairs.columns, "apart"), "near")
    one = lambda x, y: close.where(f"met_{x}").select(F.col(x).alias("a"), F.col(y).alias("b"), F.col(f"more_{x}").alias("more"), "apart")
    near = one("u", "v").union(one("v", "u"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    ranked = near.withColumn("rank", rank).where(F.col("rank") <= CHECKED + 1)
    return ranked.select("a", F.when(F.col("rank") <= CHECKED, F.col("b")).alias("b"), (F.col("more") | (F.col("rank") > CHECKED)).alias("more"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, grams: the distinct shingle hashes of each distinct text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [_shingles(t, SIMILAR_SHINGLE, 42) for t in batch.slice(at, 256).column(0).to_pylist()]
                nodes = np.array([xxhash.xxh64_intdigest(j, 42) for j, _ in found], np.uint64).view(np.int64)
                grams = pa.array([np.unique(h).view(np.int64) for _, h in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), grams], ["node", "grams"])

    return docs.select(whole("text").alias("text")).mapInArrow(sets, "node long, grams array<long>").dropDuplicates(["node"])


def _sets_of(docs: DataFrame, marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, grams of the wanted nodes (see ``shingle_sets``)."""
    keys = marked.join(wanted, "node", "left_semi").select("key").distinct()
    return stored(shingle_sets(docs.select("text", _key().alias("key")).join(keys, "key", "left_semi")), "shingles")


def _alike(docs: DataFrame, marked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs of nodes whose shingle sets are similar enough."""
    sets = _sets_of(docs, marked, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    left, right = (sets.select(F.col("node").alias(s), F.col("grams").alias(f"{s}_grams")) for s in "ab")
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    alike = both * 5 >= (F.size("a_grams") + F.size("b_grams") - both) * SIMILAR_FIFTHS
    return stored(pairs.join(left, "a").join(right, "b").where(alike).select("a", "b"), "links")


def _between(docs: DataFrame, marked: DataFrame, waiting: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b: all pairs of waiting nodes of different groups that may be similar enough.

    Of two such sets, each with its shingles from the rarest to the most
    common, the first fifth of both and one more have a shingle in common.
    """
    sets = _sets_of(docs, marked, waiting).join(groups, "node", "left")
    each = sets.select("node", F.coalesce("component", "node").alias("group"), F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    rarest = Window.partitionBy("node").orderBy("n", "gram")
    ranked = each.join(each.groupBy("gram").agg(F.count("*").alias("n")), "gram").withColumn("rank", F.row_number().over(rarest))
    first = stored(ranked.where(F.expr(f"rank <= size - (size * {SIMILAR_FIFTHS} + 4) div 5 + 1")).select("gram", "node", "group", "rank", "size"), "prefixes")
    several = first.groupBy("gram").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("gram")
    a, b = (first.join(several, "gram", "left_semi").select(F.col("gram").alias(f"{s}_gram"), *(F.col(c).alias(f"{s}_{c}") for c in ("node", "group", "rank", "size"))) for s in "ab")
    # At the first common shingle, what lies behind it must hold four ninths of both sets together.
    enough = (F.least(F.col("a_size") - F.col("a_rank"), F.col("b_size") - F.col("b_rank")) + 1) * (5 + SIMILAR_FIFTHS) >= (F.col("a_size") + F.col("b_size")) * SIMILAR_FIFTHS
    met = a.join(b, (F.col("a_gram") == F.col("b_gram")) & (F.col("a_group") < F.col("b_group")) & enough)
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def similar_links(docs: DataFrame, marked: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: links with the components of ``known`` links and of those among the nodes of ``marked`` (see ``sketches``) whose shingle sets are similar enough.

    First the nearest candidates of each node are checked. Nodes that had more
    are then compared, between the components found so far, by their rarest
    shingles. A link inside a component adds nothing to it, so the components
    are those of all candidates.
    """
    nodes = stored(marked.drop("doc_id", "key", "fp").dropDuplicates(["node"]), "nodes")
    found = stored(similar_candidates(nodes), "candidates")
    pairs = stored(found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    links = known.union(_alike(docs, marked, pairs))
    waiting = stored(found.where("more").select(F.col("a").alias("node")).distinct(), "waiting")
    if waiting.isEmpty():
        return links
    groups = components(links, "a", "b")
    rest = _between(docs, marked, waiting, groups)
    return groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_alike(docs, marked, stored(rest.join(pairs, ["a", "b"], "left_anti"), "candidates")))


def without_similar(docs: DataFrame) -> DataFrame:
    """One row of each group of similar texts, with all columns of ``docs``: that of the smallest doc_id.

    Texts are similar where the Jaccard similarity of their five-word shingle
    sets is 0.8 or more, or where their fingerprints are near-duplicates (see
    ``near_classes``); groups are the components of both kinds of links. Texts
    of equal words are one. Null ids, and repeated rows of one id, are taken
    as in ``without_near_duplicates``.
    """
    marked = stored(sketches(docs.select("doc_id", "text")), "sketches")
    # Links of fingerprints become links of their least nodes: the components of all links are found together.
    first = stored(marked.groupBy("fp").agg(F.min("node").alias("first")), "nodes")
    alike = marked.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    ends = [first.select(F.col("fp").alias(s), F.col("first").alias(f"{s}_node")) for s in "ab"]
    linked_prints = near_links(first.select("fp")).join(ends[0], "a").join(ends[1], "b")
    close = alike.union(linked_prints.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))).distinct()
    linked = components(similar_links(docs, marked, stored(close, "close")), "a", "b")
    joined = marked.select("node").distinct().join(linked, "node", "left")
    classed = stored(joined.select("node", F.coalesce("component", "node").alias("component")), "components")
    return _first_rows(docs, marked, "node", classed)
