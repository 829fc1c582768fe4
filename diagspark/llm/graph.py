"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import stored


def _kept(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The distinct edges, stored, and their count and order-free hash, taken as they are written: equal for equal sets."""
    state = Observation()
    row = F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")
    kept = stored(edges.distinct().observe(state, *row), name)
    return kept, (state.get["n"], state.get["h"])


def _exploded(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """u, v: for each row an edge from each pair of its columns, in one scan."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends))))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, component of every node of ``links``; component is the least node reachable.

    Alternates the large-star and small-star steps until every edge points
    from a node to its component's least node. Each round is a few joins and
    aggregations and is written to the shared folder; nothing is collected
    but a count and a hash, which come with the writing. Nodes without a link are not in the result; null
    ends are ignored.
    """
    ends = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges, before = _kept(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while before[0]:
        both = _exploded(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # Large star: a node's larger neighbours now point to its least neighbour.
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # Small star: a node's smaller neighbours, and the node, point to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges, after = _kept(_exploded(large.join(low, "u"), ("u", "m"), ("v", "m")).where("u <> v"), "small-star")
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
