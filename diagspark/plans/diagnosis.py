"""The diagnosis job: series to statistics, scores, anomalies and findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.anomalies import anomalies, describe_intervals, intervals_above, thresholds_table
from ..operators.rules import Rule, diagnose
from ..operators.scoring import core_watermarks, formula_table, score
from ..operators.series import SERIES, downsample, first_value, slice_range
from ..operators.stats import PERCENTILES, aligned, fragmentation, index_percentiles, mean_ratio_in_time
from ..operators.wide import Points, points_of, session

#: Names of entity series as metrics of their own.
ENTITY_PREFIX = {"disk_util": "disku_", "disk_iops": "iops_", "repl_lag": "repl_lag_"}


def percentiles_in_range(points: Points, start: Column, end: Column) -> DataFrame:
    """host, metric, entity, n, p5, median, p95 of the downsampled series over a range."""
    if isinstance(points, DataFrame):
        return index_percentiles(downsample(slice_range(points, start, end)), SERIES)
    return reduce(DataFrame.unionByName, [w.percentiles(start, end) for w in points])


def compute_stats(points: Points, start: Column, end: Column, info: DataFrame) -> DataFrame:
    """host, metric, n, p5, median, p95 of every series over a range, with the facts that scoring needs.

    ``info`` has host, mem_size_mb, num_cores. Entity series are named after
    their entity. ``points`` is in long form, or wide where series share their
    samples, which shuffles and sorts a row a sample.
    """
    prefix = F.create_map(*(F.lit(x) for pair in ENTITY_PREFIX.items() for x in pair))[F.col("metric")]
    stats = percentiles_in_range(points, start, end).withColumn("metric", F.when(prefix.isNotNull(), F.concat(prefix, "entity")).otherwise(F.col("metric"))).drop("entity")
    first = first_value(points_of(points, ("wt_cache_max", "queues_read_total", "queues_write_total")), ("host", "metric"))
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    facts = first.groupBy("host").agg(pick("wt_cache_max").alias("cache_gb"), pick("queues_read_total").alias("read_tickets"), pick("queues_write_total").alias("write_tickets"))
    ratios = mean_ratio_in_time(points_of(points, ("scan_objects", "scan_keys")), "scan_objects", "scan_keys")
    known = stats.join(info.select("host", "mem_size_mb"), "host", "left").join(facts, "host", "left").join(ratios, "host", "left")
    tickets = F.when(F.col("metric") == "queues_read_out", F.col("read_tickets")).when(F.col("metric") == "queues_write_out", F.col("write_tickets"))
    return known.withColumn("tickets", tickets).drop("read_tickets", "write_tickets")


def fragmentation_stats(points: Points, start: Column, end: Column) -> DataFrame:
    """host, metric, label, score and statistics of the allocator's fragmentation over a range."""
    names = ("tcmalloc_heap", "tcmalloc_in_use")
    if isinstance(points, DataFrame):
        cut = downsample(slice_range(points_of(points, names), start, end))
    else:
        cut = reduce(DataFrame.unionByName, [w.downsampled(start, end) for w in (p.only(names) for p in points) if w.series])
    frag = fragmentation(aligned(cut, *names, ("heap", "in_use")))
    return frag.select("host", F.lit("tcmalloc_fragmentation").alias("metric"), F.lit("tcmalloc_frag %").alias("label"), F.col("score").cast("int").alias("score"), *(n for n, _ in PERCENTILES))


def scored_stats(points: Points, start: Column, end: Column, info: DataFrame, strict_parity: bool = False) -> DataFrame:
    """Statistics with scores by each host's watermarks, the allocator's fragmentation over the same range among them."""
    stats, formulas = compute_stats(points, start, end, info), formula_table(session(points))
    if "num_cores" in info.columns:
        formulas = core_watermarks(formulas, stats.select("host").distinct().join(info, "host", "left"))
    scored = score(stats, formulas, strict_parity).select("host", "metric", "label", "score", *(n for n, _ in PERCENTILES))
    return scored.unionByName(fragmentation_stats(points, start, end))


def symptom_times(points: Points, stats: DataFrame) -> DataFrame:
    """host, times: when connections were above 1.5 times their median, and when each member's lag was above 5 s, as texts by metric."""
    medians = stats.where(F.col("metric") == "conns_current").select("host", (1.5 * F.col("median")).alias("bound"))
    many = points_of(points, ("conns_current",)).join(medians, "host")
    late = points_of(points, ("repl_lag",))
    keys = ("host", "metric", "entity")
    texts = describe_intervals(intervals_above(many, F.col("bound")), keys).unionByName(describe_intervals(intervals_above(late, F.lit(5.0)), keys))
    name = F.concat_ws("_", "metric", F.when(F.col("entity") != "", F.col("entity")))
    return texts.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct(name.alias("metric"), "text"))).alias("times"))


def diagnosis(points: Points, start: Column, end: Column, info: DataFrame, rules: Sequence[Rule] | None = None, thresholds: DataFrame | None = None) -> dict[str, DataFrame]:
    """stats, anomalies and findings of all hosts; the symptoms of connections and of each member's lag say when."""
    stats = scored_stats(points, start, end, info)
    found = diagnose(stats, rules).join(symptom_times(points, stats), "host", "left")
    metric = lambda s: F.concat_ws("_", s["name"], F.when(s["entity"] != "", s["entity"]))
    timed = F.transform("symptoms", lambda s: s.withField("timing", F.col("times")[metric(s)]))
    findings = found.withColumn("symptoms", timed).drop("times")
    thresholds = thresholds if thresholds is not None else thresholds_table(session(points))
    judged = points_of(points, [r["metric"] for r in thresholds.select("metric").distinct().collect()])
    return {"stats": stats, "anomalies": anomalies(judged, thresholds), "findings": findings}
