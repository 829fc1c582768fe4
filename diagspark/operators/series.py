"""Counters and gauges as series: rates, deltas, ratios, lag, slices, buckets.

A sample table has host, ts, seq and counters as columns; a series table
(``points``) has host, metric, entity, ts, seq, value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp0, ratio, seconds_between
from .thinning import thin
from .windows import ORDER, numbered, previous

SERIES = ("host", "metric", "entity")
MAX_POINTS = 1800


def guarded(samples: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("host",), uptime: str = "uptime", ts: str = "ts", order: Sequence[str] = ORDER) -> DataFrame:
    """Samples whose uptime grew, with prev_ columns and ``seconds`` since the sample before (at least 1, rounded).

    The sample before is the one just before in time, also if that was itself
    left out; the first sample of a key compares with uptime 0.
    """
    wanted = list(dict.fromkeys([*columns, uptime, ts]))
    found = previous(samples, wanted, keys, order).where(F.col(uptime) > F.coalesce(F.col(f"prev_{uptime}"), F.lit(0)))
    return found.withColumn("seconds", F.greatest(F.lit(1.0), F.round(seconds_between(F.col(f"prev_{ts}"), F.col(ts)))))


def gauge(samples: DataFrame, column: str, keys: Sequence[str] = ("host",), uptime: str = "uptime", order: Sequence[str] = ORDER) -> DataFrame:
    """A gauge at samples whose uptime grew: keys, order, value."""
    return guarded(samples, [column], keys, uptime, order=order).select(*keys, *order, F.col(column).cast("double").alias("value"))


def counter_rate(samples: DataFrame, column: str, keys: Sequence[str] = ("host",), uptime: str = "uptime", order: Sequence[str] = ORDER) -> DataFrame:
    """Growth of a counter per second since the sample before; a falling counter gives 0."""
    found = guarded(samples, [column], keys, uptime, order=order).where(F.col(f"prev_{order[0]}").isNotNull())
    return found.select(*keys, *order, (clamp0(F.col(column) - F.col(f"prev_{column}")) / F.col("seconds")).alias("value"))


def delta_ratio(samples: DataFrame, part: str, whole: str, keys: Sequence[str] = ("host",), uptime: str = "uptime", order: Sequence[str] = ORDER) -> DataFrame:
    """Growth of one counter over growth of another; 0 unless the other grew."""
    found = guarded(samples, [part, whole], keys, uptime, order=order).where(F.col(f"prev_{order[0]}").isNotNull())
    grown = F.col(whole) - F.col(f"prev_{whole}")
    return found.select(*keys, *order, F.when(grown > 0, clamp0(ratio(F.col(part) - F.col(f"prev_{part}"), grown))).otherwise(0.0).alias("value"))


def cumulative_ratio(samples: DataFrame, part: str, whole: str, keys: Sequence[str] = ("host",), uptime: str = "uptime", order: Sequence[str] = ORDER, divisor: float = 1000.0) -> DataFrame:
    """Total of one counter over total of another (not their growth); 0 without any."""
    found = guarded(samples, [part, whole], keys, uptime, order=order)
    return found.select(*keys, *order, F.when(F.col(whole) > 0, ratio(F.col(part), F.col(whole)) / divisor).otherwise(0.0).alias("value"))


def counter_delta(samples: DataFrame, column: str, keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER, per_second: bool = False) -> DataFrame:
    """Growth since the sample before, without a guard; the first sample gives none. Seconds are not rounded."""
    found = previous(samples, [column, order[0]], keys, order).where(F.col(f"prev_{order[0]}").isNotNull())
    seconds = F.greatest(F.lit(1.0), seconds_between(F.col(f"prev_{order[0]}"), F.col(order[0])))
    return found.select(*keys, *order, (clamp0(F.col(column) - F.col(f"prev_{column}")) / (seconds if per_second else F.lit(1.0))).alias("value"))


def entity_delta(samples: DataFrame, column: str, entity: str, number: str = "sample", keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> DataFrame:
    """Growth of each entity's counter since the sample before, where an entity that was absent counts 0.

    ``number`` counts the samples of a key from 0; sample 0 gives none.
    """
    found = previous(samples, [column, number], [*keys, entity], order)
    before = F.when(F.col(f"prev_{number}") == F.col(number) - 1, F.col(f"prev_{column}")).otherwise(0)
    return found.where(F.col(number) > 0).select(*keys, entity, *order, clamp0(F.col(column) - before).alias("value"))


def share_of_delta(samples: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> DataFrame:
    """For each counter, its percentage of the growth of all; the divisor is 1 if nothing grew. Long form: metric, value."""
    found = previous(samples, [*columns, order[0]], keys, order).where(F.col(f"prev_{order[0]}").isNotNull())
    grown = [(F.col(c) - F.col(f"prev_{c}")).cast("double") for c in columns]
    total = sum(grown[1:], grown[0])
    whole = F.when(total == 0, F.lit(1.0)).otherwise(total)
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), clamp0(100 * g / whole).alias("value")) for c, g in zip(columns, grown, strict=True)))
    return found.select(*keys, *order, F.explode(rows).alias("x")).select(*keys, *order, "x.metric", "x.value")


def replication_lag(statuses: DataFrame, keys: Sequence[str] = ("host",), ts: str = "ts") -> DataFrame:
    """Seconds that each member's optime is behind the primary's: keys, ts, entity (host-N by name), value.

    ``members`` is array<struct<name, state, optime_s>>. A status emits if it
    has as many members as the status before it and a primary (state 1) with an
    optime; arbiters (state 7) are left out, other states than secondary give 0.
    """
    sized = statuses.where(F.size("members") > 0).withColumn("count", F.size("members"))
    found = previous(sized, ["count"], keys, [ts]).where(F.col("count") == F.col("prev_count"))
    sorted_members = F.array_sort("members", lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    named = found.withColumn("members", sorted_members)
    primary = F.get(F.filter("members", lambda m: m["state"] == 1), F.lit(0))["optime_s"]
    led = named.withColumn("primary", primary).where(F.coalesce(F.col("primary"), F.lit(0)) != 0)
    each = led.select(*keys, ts, "primary", F.posexplode("members").alias("at", "m")).where("m.state <> 7")
    behind = F.when(F.col("m.state") == 2, clamp0(F.col("primary") - F.col("m.optime_s"))).otherwise(0.0)
    return each.select(*keys, ts, F.concat(F.lit("host-"), F.col("at").cast("string")).alias("entity"), behind.alias("value"))


def slice_edges(points: DataFrame, start: Column, end: Column, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER) -> DataFrame:
    """keys, __from, __to: the places in order where each series' slice begins and ends; series that begin after the end have none."""
    ts, at = F.col(order[0]), F.struct(*order)
    found = points.where(ts <= end).groupBy(*keys).agg(F.max(F.when(ts <= start, at)).alias("__a"), F.min(at).alias("__first"), F.max(at).alias("__to"))
    return found.select(*keys, F.coalesce("__a", "__first").alias("__from"), "__to")


def slice_range(points: DataFrame, start: Column, end: Column, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER) -> DataFrame:
    """The points from the last one at or before ``start`` up to, not with, the last one at or before ``end``.

    Where no point lies that early the series' first point counts; so the
    last point of a full range is left out. Adds ``n``, the place in the
    slice, and ``total``, its size. The order has to be unique in a series.

    Only times and keys up to the end are read for the edges; of the points,
    those from the earliest edge on (both bounds reach the scan of stored
    points), and only the slice is numbered.
    """
    keys, order, names = list(keys), list(order), points.columns
    edges = slice_edges(points, start, end, keys, order)
    earliest = edges.agg(F.min(F.col(f"__from.{order[0]}")).alias("t")).scalar()
    ts, at = F.col(order[0]), F.struct(*order)
    near = points.where((ts <= end) & (ts >= earliest))
    kept = near.join(edges, keys).where((at >= F.col("__from")) & (at < F.col("__to"))).select(*names)
    return numbered(kept, keys, order, "n", "total")


def bucket_avg(points: DataFrame, size: Column, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Mean value and last time of each ``size`` consecutive points (by place ``n``)."""
    grouped = points.withColumn("bucket", F.floor(F.col("n") / size)).groupBy(*keys, "bucket")
    return grouped.agg(F.avg("value").alias("value"), F.max(ts).alias(ts))


def downsample(points: DataFrame, max_points: int = MAX_POINTS, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Series of over ``max_points`` points in buckets of total div max_points points; ``points`` has n and total."""
    size = F.when(F.col("total") > max_points, F.floor(F.col("total") / max_points)).otherwise(F.lit(1))
    return bucket_avg(points, size, keys, ts)


def time_range(samples: DataFrame, ts: str = "ts") -> DataFrame:
    return samples.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def first_value(points: DataFrame, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER) -> DataFrame:
    """Each series' first value in time."""
    return points.groupBy(*keys).agg(F.min_by("value", F.struct(*order)).alias("value"))


def interval_mean(samples: DataFrame, span: float, columns: Sequence[str], keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> DataFrame:
    """Integer means of gauges over the rows after one kept row up to the next: keys, interval end, rows, means."""
    keys, order = list(keys), list(order)
    marks = thin(samples.select(*keys, *order), span, keys, order, keep_last=True).withColumn("__end", F.struct(*order))
    marked = samples.join(marks, [*keys, *order], "left")
    # The next mark: the same day's, or else the first of a later day.
    dealt = marked.withColumn("__day", F.date_trunc("day", F.col(order[0])))
    back = [F.col(c).desc() for c in order]
    inside = Window.partitionBy(*keys, "__day").orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)
    days = dealt.groupBy(*keys, "__day").agg(F.min("__end").alias("__first"))
    later = Window.partitionBy(*keys).orderBy(F.col("__day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = days.select(*keys, "__day", F.last("__first", ignorenulls=True).over(later).alias("__after"))
    near = dealt.withColumn("__near", F.last("__end", ignorenulls=True).over(inside)).join(after, [*keys, "__day"])
    placed = near.withColumn("__until", F.coalesce("__near", "__after")).where("__until is not null")
    sums = placed.groupBy(*keys, F.col(f"__until.{order[0]}").alias("until")).agg(F.count("*").alias("rows"), *(F.expr(f"sum(`{c}`) div count(*)").alias(c) for c in columns))
    return sums
