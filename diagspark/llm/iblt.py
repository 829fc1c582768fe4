"""Document fingerprints: invertible Bloom lookup sketches of paragraph pieces.

A text's paragraphs (lines; long ones in pieces) are hashed to a set of 64-bit
digests. Every digest enters one cell in each of three subtables; a cell holds
a count, the XOR of its digests and the XOR of their check hashes. The sketches
of two versions subtract cell by cell, which leaves the digests that differ;
a cell with just one of them gives it away, and taking it out of its other
cells frees more (peeling). If the small sketch that is the fingerprint cannot
be peeled empty, the pair is tried again with larger sketches, and with new
hash functions, until it can.

Everything here is Spark SQL expressions and DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bucketed, stored, whole

SUBTABLES = 3
#: Cells in each subtable of a fingerprint.
WIDTH = 8
#: A piece is 32 words of a line, or up to 8 of what is left of it.
PIECE = r" *+(?:[^ \n]++ *+){32}| *+(?:[^ \n]++ *+){1,8}"
#: Failed pairs of an attempt that are broadcast at most (24 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1 << 18
#: Passes over the three subtables in one attempt at peeling.
PASSES = 6


def digests(text: Column) -> Column:
    """The distinct 64-bit hashes of the text's paragraph pieces; none for a text without words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p))))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(digest: Column, subtable: int | Column, width: Column, seed: int = 0) -> Column:
    subtable = F.lit(subtable) if isinstance(subtable, int) else subtable
    return F.pmod(F.xxhash64(digest, F.lit(seed), subtable), width)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later expressions can use many times but that are computed once (the optimiser does not copy them past a generator)."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__once")
    return df.select("*", made).select(*df.columns, *(F.col(f"__once.{n}").alias(n) for n in columns))


def placed(found: Column, width: int = WIDTH) -> Column:
    """Each digest of a set with its check hash and its cell in each subtable."""
    return F.transform(found, lambda d: F.struct(d.alias("d"), _check(d).alias("h"), *(_cell(d, s, F.lit(width)).alias(f"i{s}") for s in range(SUBTABLES))))


def _subtable(spots: Column, s: int, width: int) -> Column:
    empty = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    added = lambda acc, p: F.struct((acc["c"] + 1).alias("c"), acc["k"].bitwiseXOR(p["d"]).alias("k"), acc["h"].bitwiseXOR(p["h"]).alias("h"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda i: F.aggregate(F.filter(spots, lambda p: p[f"i{s}"] == i), empty, added))


def sketch(spots: Column, width: int = WIDTH) -> Column:
    """The cells (count, digest XOR, check XOR) of placed digests, in one row."""
    return F.concat(*(_subtable(spots, s, width) for s in range(SUBTABLES)))


def sketch_text(cells: Column) -> Column:
    """The cells as lower-case hex: 6 digits of count, 16 of digests, 8 of checks each."""
    digit = lambda v, n: F.lpad(F.hex(v), n, "0")
    return F.lower(F.array_join(F.transform(cells, lambda x: F.concat(digit(x["c"], 6), digit(x["k"], 16), digit(x["h"], 8))), ""))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def _pure(c: Column, k: Column, h: Column) -> Column:
    return (F.abs(c) == 1) & (h == _check(k))


def peeled_small(cells: Column, width: int = WIDTH) -> Column:
    """How many digests peeling recovers from a subtracted sketch in one row; null if cells are left."""
    taken = lambda x, p: F.struct((x["c"] - p["c"]).alias("c"), x["k"].bitwiseXOR(p["k"]).alias("k"), x["h"].bitwiseXOR(p["h"]).alias("h"))
    none = lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0)

    def step(state: Column, own: Column) -> Column:
        at = lambda i: (i / width).cast("int")
        pure = F.filter(state["cells"], lambda x, i: (at(i) == own) & _pure(x["c"], x["k"], x["h"]))
        less = lambda found: F.transform(state["cells"], lambda x, i: F.aggregate(found, x, lambda y, p: F.when(_cell(p["k"], at(i), F.lit(width)) == i % width, taken(y, p)).otherwise(y)))
        after = lambda found: F.struct(less(found).alias("cells"), (state["n"] + F.size(found)).alias("n"))
        return F.when(F.forall(state["cells"], none), state).otherwise(F.transform(F.array(pure), after)[0])

    start = F.struct(cells.alias("cells"), F.lit(0).alias("n"))
    hopeful = F.exists(cells, lambda x: _pure(x["c"], x["k"], x["h"])) | F.forall(cells, none)
    turns = F.array(*(F.lit(i % SUBTABLES) for i in range(SUBTABLES * PASSES)))
    return F.when(hopeful, F.aggregate(turns, start, step, lambda state: F.when(F.forall(state["cells"], none), state["n"].cast("long"))))


def _summed(spots: DataFrame, keys: list[str]) -> DataFrame:
    """The cells that are not empty. The key is a struct: for plain columns each of the many sums in a row would hold a page of memory to the task's end."""
    cell = F.struct(*keys[1:], "width", "s", "i").alias("cell")
    added = spots.select(keys[0], cell, "c", "k", "h").groupBy(keys[0], "cell").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return added.where("c <> 0 or k <> 0 or h <> 0").select(keys[0], "cell.*", "c", "k", "h")


def peeled(cells: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """keys, differing, left: digests recovered from subtracted sketches, and cells that could not be emptied.

    ``cells`` has keys, width, s, i, c, k, h, a row a cell that is not empty.
    Subtables are peeled in turn: a digest lies in one cell of each, so none is
    taken out twice. A pair whose sketches are equal has no row.
    """
    for step in range(SUBTABLES * PASSES):
        own = step % SUBTABLES
        one = lambda s, i, c, k, h: F.struct(F.lit(s).alias("s"), i.alias("i"), c.alias("c"), k.alias("k"), h.alias("h"))
        zero = F.lit(0).cast("long")
        gone = [one(s, _cell(F.col("k"), s, F.col("width"), seed), -F.col("c"), F.col("k"), F.col("h")) for s in range(SUBTABLES) if s != own]
        # Row s = 3 counts what was recovered.
        freed = F.array(one(SUBTABLES, zero, zero + 1, zero, zero), *gone)
        itself = F.array(F.struct("s", "i", "c", "k", "h"))
        moved = cells.select(*keys, "width", F.explode(F.when((F.col("s") == own) & _pure(F.col("c"), F.col("k"), F.col("h")), freed).otherwise(itself)).alias("x"))
        cells = _summed(moved.select(*keys, "width", "x.*"), keys)
    counted = F.sum(F.when(F.col("s") == SUBTABLES, F.col("c")).otherwise(0))
    return cells.groupBy(*keys).agg(counted.alias("differing"), F.sum(F.when(F.col("s") < SUBTABLES, 1).otherwise(0)).alias("left"))


def differences(sets: DataFrame, keys: list[str], seed: int, scale: int = 1) -> DataFrame:
    """keys, differing, left of digest sets ``a`` and ``b`` (arrays), with sketches of about ``scale`` times their size."""
    width = F.greatest(F.lit(4), F.ceil((F.size("a") + F.size("b")) * (0.5 * scale)) + 4).cast("long")
    sized = sets.withColumn("width", width)
    plus, minus = (F.transform(side, lambda d: F.struct(d.alias("k"), n.cast("long").alias("c"))) for side, n in (("a", F.lit(1)), ("b", F.lit(-1))))  # noqa: B023
    items = sized.select(*keys, "width", F.explode(F.concat(plus, minus)).alias("x")).select(*keys, "width", "x.k", "x.c")
    spots = items.select("*", F.explode(F.array(*(F.lit(s) for s in range(SUBTABLES)))).alias("s"))
    placed = spots.select(*keys, "width", "s", _cell(F.col("k"), F.col("s"), F.col("width"), seed).alias("i"), "c", "k", _check(F.col("k")).alias("h"))
    return peeled(_summed(placed, keys), keys, seed)


def _numbers(values: list, kind: str) -> Column:
    """A list as one literal, however long: the plan does not get a node for each value."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _place(edges: list[int], value: Column) -> tuple[Column, Column]:
    """The last of the sorted edges that is at most the value, as a place from 0; and whether it equals the value.

    Found in levels of every 32nd edge, so a row looks at 32 edges a level.
    """
    step, levels = 32, [edges]
    while len(levels[-1]) > step:
        levels.append(levels[-1][::step])
    place = None
    for level in reversed(levels):
        part = _numbers(level, "long")
        if place is not None:
            part = F.slice(part, place * step + 1, F.lit(step))
        here = F.size(F.filter(part, lambda b: b <= value)) - 1
        place = here if place is None else place * step + here
    return place, F.get(_numbers(edges, "long"), place) == value


def with_next(docs: DataFrame, tasks: int) -> DataFrame:
    """part, at, doc_id, text, next_text: every document beside the one that follows it by (doc_id, text); the last beside the first.

    Documents are dealt to ranges of doc_id that begin at approximate
    quantiles; each range also gets the first document of the next one, so one
    exchange of the texts does. Null ids come after all others, in ranges of
    their text's hash. (part, at) is a key; rows are dealt to ``tasks`` by part.
    """
    ranges = 8 * tasks
    rows = docs.select("doc_id", whole("text").alias("text")).withColumn("hash", F.xxhash64("text"))
    found = rows.agg(F.percentile_approx("doc_id", _numbers([i / ranges for i in range(1, ranges)], "double"), 100 * ranges).alias("q"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted({*(found["q"] or []), *([] if found["least"] is None else [found["least"]])})
    slots = rows.where("doc_id is null").groupBy(F.floor((F.col("hash") / 2.0**64 + 0.5) * ranges)).agg(F.min("hash").alias("least"))
    unnamed = sorted(r["least"] for r in slots.collect()) if found["nulls"] else []
    named_part, named_first = _place(bounds, F.col("doc_id")) if bounds else (F.lit(0), F.lit(False))
    null_part, null_first = _place(unnamed, F.col("hash")) if unnamed else (F.lit(0), F.lit(False))
    own = F.when(F.col("doc_id").isNull(), null_part + len(bounds)).otherwise(named_part)
    begins = F.when(F.col("doc_id").isNull(), null_first).otherwise(named_first)
    spot = lambda part, wrap, real: F.struct(part.alias("part"), F.lit(wrap).alias("wrap"), F.lit(real).alias("real"))
    before = F.when(F.col("own") == 0, spot(F.lit(len(bounds) + len(unnamed) - 1), 1, False)).otherwise(spot(F.col("own") - 1, 0, False))
    spots = F.when(F.col("begins"), F.array(spot(F.col("own"), 0, True), before)).otherwise(F.array(spot(F.col("own"), 0, True)))
    dealt = rows.withColumns({"own": own, "begins": begins}).select("doc_id", "text", "hash", F.explode(spots).alias("x")).select("doc_id", "text", "hash", "x.*")
    order = Window.partitionBy("part").orderBy("wrap", F.col("doc_id").asc_nulls_last(), "hash", "text", F.col("real").desc())
    placed = dealt.repartition(tasks, "part").withColumns({"next_text": F.lead("text").over(order), "at": F.row_number().over(order)})
    return placed.where("real").select("part", "at", "doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def edited(text: str, following: str) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    A likeness is 1 - d / (a + b): d paragraph pieces that differ, of a and b
    distinct ones; 1 for two texts without words. Null texts are empty.
    Repeated rows follow one another and give a row each; the documents of an
    empty table give none; a single document is its own next.

    The digest sets are written in buckets by part, so that the sketches of
    all attempts are added up and peeled without another exchange.
    """
    tasks, keys = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["part", "at"]
    paired = once(with_next(docs.select("doc_id", "text"), tasks), edit_text=edited("text", "next_text"))
    sides = {"own": "text", "edit": "edit_text", "next": "next_text"}
    sets = once(paired, **{n: digests(F.col(c)) for n, c in sides.items()})
    spots = once(sets, **{f"{n}_spots": placed(F.col(n)) for n in sides})
    cells = once(spots, **{f"{n}_cells": sketch(F.col(f"{n}_spots")) for n in sides})
    less = once(cells, **{f"{n}_less": subtract(F.col("own_cells"), F.col(f"{n}_cells")) for n in ("edit", "next")})
    # Attempt 0 peels the fingerprints.
    light = less.select(
        *keys, "doc_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edit_text", 256)).alias("sha"), *sides, *(peeled_small(F.col(f"{n}_less")).alias(f"small_{n}") for n in ("edit", "next"))
    )
    table = bucketed(light, "sketches", tasks, "part")
    pairs = ((1, "edit"), (2, "next"))
    both = F.array(*(F.struct(F.lit(n).alias("pair"), F.col("own").alias("a"), F.col(c).alias("b"), F.col(f"small_{c}").alias("small")) for n, c in pairs))
    rows = table.select(*keys, F.explode(both).alias("x")).select(*keys, "x.*")
    waiting, attempt, found = rows.where("small is null"), 1, None
    while True:
        tried = stored(differences(waiting, [*keys, "pair"], attempt, 1 << (attempt - 1)), "peeled")
        done = tried.where("left = 0").select(*keys, "pair", "differing")
        found = done if found is None else found.union(done)
        failed = tried.where("left > 0").select(*keys, "pair")
        n = failed.count()
        if not n:
            break
        waiting, attempt = rows.join(F.broadcast(failed) if n <= MOST_BROADCAST else failed, [*keys, "pair"], "left_semi"), attempt + 1
    by_row = found.groupBy(*keys).agg(*(F.sum(F.when(F.col("pair") == n, F.col("differing"))).alias(f"large_{c}") for n, c in pairs))
    # Pairs whose larger sketches cancelled out have no row: nothing differs.
    differing = lambda c: F.coalesce(f"small_{c}", f"large_{c}", F.lit(0))
    near = lambda c, size: F.when(F.size("own") + size == 0, F.lit(1.0)).otherwise(1 - differing(c) / F.greatest(F.lit(1), F.size("own") + size)).cast("double")
    wide = table.select(*keys, "doc_id", "n_chars", "sha", "own", "edit", F.size("next").alias("next_size"), "small_edit", "small_next").join(by_row, keys, "left")
    shown = once(once(wide, own_spots=placed(F.col("own")), edit_spots=placed(F.col("edit"))), own_cells=sketch(F.col("own_spots")), edit_cells=sketch(F.col("edit_spots")))
    return shown.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), sketch_text(F.col("own_cells")).alias("fingerprint"), sketch_text(F.col("edit_cells")).alias("edited_fingerprint"),
        near("edit", F.size("edit")).alias("near_edited"), near("next", F.col("next_size")).alias("near_next"),
    )
