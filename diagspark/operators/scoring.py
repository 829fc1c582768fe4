"""Scores of metrics against low and high watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import UNKNOWN, ratio, score_by_range, score_label
from .stats import rounded

FORMULA_SCHEMA = "metric string, low double, high double, formula string"
#: Metric or family (ends in _), low and high watermark, formula text.
FORMULAS = (
    ("conns_created/s", 0.0, 5.0, "conns_created/s"),
    ("conns_current", 5.0, 20.0, "1MB*(p95 of conns_current)/RAM"),
    ("cpu_idle", 50.0, 80.0, "p5 of cpu_idle"),
    ("cpu_iowait", 5.0, 15.0, "p95 of cpu_iowait"),
    ("cpu_system", 5.0, 15.0, "p95 of cpu_system"),
    ("cpu_user", 50.0, 70.0, "p95 of cpu_user"),
    ("disku_", 50.0, 90.0, "p95 of disku_<dev>"),
    ("iops_", 2.0, 4.0, "(p95 of iops_<dev>)/(avg of iops_<dev>)"),
    ("latency_command", 20.0, 100.0, "p95 of latency_command"),
    ("latency_read", 20.0, 100.0, "p95 of latency_read"),
    ("latency_write", 20.0, 100.0, "p95 of latency_write"),
    ("mem_page_faults", 10.0, 20.0, "p95 of mem_page_faults"),
    ("mem_resident", 70.0, 90.0, "mem_resident/RAM"),
    ("ops_", 0.0, 64000.0, "ops_<op>"),
    ("queued_read", 1.0, 5.0, "p95 of queued_read"),
    ("queued_write", 1.0, 5.0, "p95 of queued_write"),
    ("scan_keys", 0.0, 1048576.0, "scan_keys"),
    ("scan_objects", 2.0, 5.0, "avg of [](scan_objects/scan_keys)"),
    ("scan_sort", 0.0, 1000.0, "scan_sort"),
    ("wt_cache_used", 80.0, 95.0, "(p95 of wt_cache_used)/wt_cache_max"),
    ("wt_cache_dirty", 5.0, 20.0, "(p95 of wt_cache_dirty)/wt_cache_max"),
    ("wt_dhandles_active", 16000.0, 20000.0, "(p95 of wt_dhandles_active)"),
    ("wt_modified_evicted", 5.0, 10.0, "(p95 of wt_modified_evicted)/(pages of wt_cache_max)"),
    ("wt_unmodified_evicted", 5.0, 10.0, "(p95 of wt_unmodified_evicted)/(pages of wt_cache_max)"),
    ("query_targeting_keys", 10.0, 100.0, "p95 of (keys_examined/docs_returned)"),
    ("query_targeting_objects", 10.0, 100.0, "p95 of (docs_examined/docs_returned)"),
    ("write_conflicts/s", 10.0, 100.0, "p95 of write_conflicts/s"),
    ("repl_lag_", 5.0, 30.0, "p95 of replication lag"),
    ("queues_read_out", 50.0, 90.0, "(p95 of queues_read_out)/queues_read_total"),
    ("queues_write_out", 50.0, 90.0, "(p95 of queues_write_out)/queues_write_total"),
    ("txn_inactive", 5.0, 20.0, "p95 of txn_inactive"),
    ("txn_aborted/s", 10.0, 50.0, "p95 of txn_aborted/s"),
    ("tcmalloc_fragmentation", 20.0, 50.0, "(heap-in_use)/heap"),
    ("flowctl_lagged_count", 1.0, 3.0, "p95 of flowctl_lagged_count"),
    ("flowctl_acquiring_us", 100.0, 1000.0, "p95 of flowctl_acquiring_us/1000"),
)
FAMILIES = ("disku_", "iops_", "ops_", "repl_lag_")
#: Longest range of an assessment.
MOST_HOURS = 72


def formula_table(spark: SparkSession) -> DataFrame:
    """The formulas by metric."""
    return spark.createDataFrame(list(FORMULAS), FORMULA_SCHEMA).orderBy("metric")


def core_watermarks(formulas: DataFrame, info: DataFrame) -> DataFrame:
    """The formulas of each host: those of queued operations go from its number of cores to five times that."""
    queued = F.col("metric").isin("queued_read", "queued_write") & F.col("num_cores").isNotNull()
    both = info.select("host", "num_cores").crossJoin(F.broadcast(formulas))
    return both.select("host", "metric", F.when(queued, F.col("num_cores")).otherwise(F.col("low")).cast("double").alias("low"), F.when(queued, 5 * F.col("num_cores")).otherwise(F.col("high")).cast("double").alias("high"), "formula")


def cache_pages(cache_gb: Column) -> Column:
    """5 % of the cache in pages of 4 KB."""
    return F.floor(F.lit(0.05) * cache_gb * 1024 * 1024 * 1024 / 4096)


def formula_key(metric: Column, strict_parity: bool = False) -> Column:
    """The formula that a metric looks up: its own, or its family's; queued operations lose ``q_`` unless ``strict_parity``."""
    key = metric
    for family in FAMILIES:
        key = F.when(metric.startswith(family), F.lit(family)).otherwise(key)
    return key if strict_parity else F.when(metric.startswith("q_queued_"), F.substr(metric, F.lit(3))).otherwise(key)


def _over(a: Column, b: Column) -> Column:
    """a / b, where a positive number over 0 is beyond every watermark and 0 over 0 unknown."""
    return F.when(b != 0, ratio(a, b)).when(a > 0, F.lit(float("inf")))


def scored_value(strict_parity: bool = False) -> Column:
    """The number of a metric that is scored; null if it has none. Columns as in ``score``."""
    m, p5, median, p95 = F.col("metric"), F.col("p5"), F.col("median"), F.col("p95")
    positive = F.when(p95 > 0, p95)
    return (
        F.when(m == "conns_created/s", median)
        .when(m == "conns_current", _over(100 * p95, F.col("mem_size_mb")))
        .when(m == "cpu_idle", p5)
        .when(m.startswith("iops_"), F.when(p95 >= 100, _over(p95, median)))
        .when(m == "scan_objects", F.when(p95 < 1000, F.lit(float("-inf"))).otherwise(F.col("mean_ratio")))
        .when(m.isin("wt_modified_evicted", "wt_unmodified_evicted"), _over(p95, cache_pages(F.col("cache_gb"))))
        .when(m.startswith("query_targeting_") | (m == "flowctl_lagged_count"), positive)
        .when(m.isin("queues_read_out", "queues_write_out"), F.when(F.col("tickets") > 0, 100 * p95 / F.col("tickets")))
        .when(m == "flowctl_acquiring_us", p95 / 1000)
        .when(m.isin("wt_cache_used", "wt_cache_dirty"), F.when(F.col("cache_gb") > 0, 100 * p95 / F.col("cache_gb")))
        .when(m == "mem_resident", F.when(F.col("mem_size_mb") > 0, 100 * p95 / (F.col("mem_size_mb") / 1024)))
        .when(m.startswith("q_queued_"), F.lit(None) if strict_parity else p95)
        .otherwise(p95)
    )


def score(stats: DataFrame, formulas: DataFrame, strict_parity: bool = False) -> DataFrame:
    """``stats`` with score and label, and the three statistics rounded (as percentages where the metric is one).

    ``stats`` has metric, n, p5, median, p95 and the facts that some metrics
    need: mem_size_mb, cache_gb, tickets, mean_ratio (null if unknown). A
    metric without a formula, and one without points, scores 101; with
    ``strict_parity`` a metric without points counts as 0, and queued
    operations find no formula. ``formulas`` is a small table, broadcast, or
    that of ``core_watermarks``, with a row a host and metric.
    """
    keyed = stats.withColumn("__key", formula_key(F.col("metric"), strict_parity))
    if "host" in formulas.columns:
        found = keyed.join(formulas.select("host", F.col("metric").alias("__key"), "low", "high"), ["host", "__key"], "left")
    else:
        found = keyed.join(F.broadcast(formulas.select(F.col("metric").alias("__key"), "low", "high")), "__key", "left")
    if strict_parity:
        found = found.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("p5", "median", "p95")})
    plain = F.when(F.col("low").isNull(), F.lit(UNKNOWN)).otherwise(score_by_range(scored_value(strict_parity), F.col("low"), F.col("high")))
    turned = F.when((F.col("metric") == "cpu_idle") & (plain < UNKNOWN), 100 - plain).otherwise(plain)
    cache = F.col("metric").isin("wt_cache_used", "wt_cache_dirty") & (F.col("cache_gb") > 0)
    memory = (F.col("metric") == "mem_resident") & (F.col("mem_size_mb") > 0)
    unit = F.when(cache, 100 / F.col("cache_gb")).when(memory, 100 / (F.col("mem_size_mb") / 1024)).otherwise(F.lit(1.0))
    normal = F.coalesce(cache | memory, F.lit(False))
    scored = found.withColumns({"score": turned.cast("int"), "label": score_label(F.col("metric"), normal), **{c: F.col(c) * unit for c in ("p5", "median", "p95")}})
    return rounded(scored).drop("__key", "low", "high")


def assessment(scored: DataFrame, hours: float, verbose: bool = False) -> DataFrame:
    """label, score, p5, median, p95 by score and label; unscored metrics only if ``verbose``.

    Disks whose IOPS and hosts whose lag have a p95 of 0 are left out. A range
    of over 72 hours gives one row with a message.
    """
    if hours > MOST_HOURS:
        spark = scored.sparkSession
        return spark.createDataFrame([(f"The range is over {MOST_HOURS} hours", None, None, None, None)], "label string, score int, p5 double, median double, p95 double")
    idle = (F.col("metric").startswith("iops_") | F.col("metric").startswith("repl_lag_")) & (F.col("p95") == 0)
    shown = scored.where(~idle & (F.lit(verbose) | (F.col("score") < UNKNOWN)))
    return shown.select("label", "score", "p5", "median", "p95").orderBy("score", "label")
