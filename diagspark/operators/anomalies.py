"""Intervals in which a series stays beyond a bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import format_peak, seconds_between
from .series import SERIES
from .windows import ORDER, running

THRESHOLD_SCHEMA = "metric string, bound double, above boolean, severity string, label string"
#: Metric, bound, above, severity, label.
THRESHOLDS = (
    ("latency_read", 20.0, True, "warning", "> 20ms"),
    ("latency_write", 20.0, True, "warning", "> 20ms"),
    ("latency_command", 20.0, True, "warning", "> 20ms"),
    ("scan_keys", 100000.0, True, "warning", "> 100K/s"),
    ("scan_objects", 100000.0, True, "warning", "> 100K/s"),
    ("cpu_idle", 30.0, False, "warning", "< 30%"),
    ("cpu_iowait", 15.0, True, "warning", "> 15%"),
    ("mem_page_faults", 20.0, True, "warning", "> 20/s"),
    ("q_queued_read", 10.0, True, "warning", "> 10"),
    ("q_queued_write", 10.0, True, "warning", "> 10"),
    ("write_conflicts/s", 10.0, True, "warning", "> 10/s"),
    ("disk_util", 70.0, True, "warning", "> 70%"),
    ("repl_lag", 5.0, True, "critical", "> 5s"),
)


def intervals(points: DataFrame, hit: Column, peak: Column, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER) -> DataFrame:
    """Maximal runs of consecutive points that hit: keys, start, end, peak, points, seconds. Gaps in time do not split."""
    ts = order[0]
    marked = running(points.withColumn("__hit", hit), F.when(F.col("__hit"), 0).otherwise(1).cast("long"), "__run", keys, order)
    runs = marked.where("__hit").groupBy(*keys, "__run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), peak.alias("peak"), F.count("*").alias("points"))
    return runs.withColumn("seconds", seconds_between(F.col("start"), F.col("end"))).drop("__run")


def intervals_above(points: DataFrame, bound: Column, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER) -> DataFrame:
    return intervals(points, F.col("value") > bound, F.max("value"), keys, order)


def intervals_below(points: DataFrame, bound: Column, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER) -> DataFrame:
    return intervals(points, F.col("value") < bound, F.min("value"), keys, order)


def thresholds_table(spark) -> DataFrame:
    return spark.createDataFrame(list(THRESHOLDS), THRESHOLD_SCHEMA)


def anomalies(points: DataFrame, thresholds: DataFrame, least_seconds: float = 10.0, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER) -> DataFrame:
    """Runs beyond each metric's threshold that last at least ``least_seconds``, with severity and label.

    ``thresholds`` is a small dimension table (a row a metric), broadcast.
    """
    known = points.join(F.broadcast(thresholds), "metric")
    hit = F.when(F.col("above"), F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))
    peak = F.when(F.first("above"), F.max("value")).otherwise(F.min("value"))
    found = intervals(known, hit, peak, [*keys, "severity", "label"], order)
    return found.where(F.col("seconds") >= least_seconds)


def timeline(found: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` anomalies in time, each with the number of those left out."""
    more = found.agg(F.greatest(F.lit(0).cast("long"), F.count("*") - n).alias("left_out"))
    order = [c for c in ("start", "metric", "entity", "host") if c in found.columns]
    return found.orderBy(*order).limit(n).withColumn("left_out", more.scalar())


def summarize_intervals(ranges: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Count, total seconds and largest peak (at least 0) of each key's intervals."""
    return ranges.groupBy(*keys).agg(
        F.count("*").alias("count"), F.sum("seconds").alias("seconds"), F.greatest(F.lit(0.0), F.max("peak")).alias("peak"), F.min("start").alias("start"), F.max("end").alias("end")
    )


def describe_intervals(ranges: DataFrame, keys: Sequence[str] = SERIES, metric: str = "metric") -> DataFrame:
    """keys, text: one interval by its times, several by number and total minutes."""
    found = summarize_intervals(ranges, keys)
    peak, minutes = format_peak(F.col("peak"), F.col(metric)), F.format_string("%.0f", F.col("seconds") / 60)
    at = lambda c: F.date_format(c, "HH:mm:ss")
    short = F.concat(F.lit("at "), at("start"), F.lit(" (peak: "), peak, F.lit(")"))
    one = F.concat(at("start"), F.lit(" to "), at("end"), F.lit(" ("), minutes, F.lit("m, peak: "), peak, F.lit(")"))
    many = F.concat(F.col("count").cast("string"), F.lit(" occurrences over "), minutes, F.lit("m (peak: "), peak, F.lit(")"))
    return found.select(*keys, F.when(F.col("count") > 1, many).when(F.col("seconds") < 60, short).otherwise(one).alias("text"))
