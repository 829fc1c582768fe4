"""The metric catalogue, and the job that turns samples into series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import UNITS, clamp0, ratio
from ..operators.series import guarded, replication_lag, share_of_delta
from ..operators.wide import Wide
from ..operators.windows import previous
from .scratch import scratch

#: Metric, kind, source paths below serverStatus, unit. Kinds: gauge, rate, cum-ratio, delta-ratio.
STATUS_METRICS = (
    ("mem_resident", "gauge", ("mem/resident",), "mb_to_gb"),
    ("mem_virtual", "gauge", ("mem/virtual",), "mb_to_gb"),
    ("conns_active", "gauge", ("connections/active",), ""),
    ("conns_available", "gauge", ("connections/available",), ""),
    ("conns_current", "gauge", ("connections/current",), ""),
    ("q_active_read", "gauge", ("globalLock/activeClients/readers",), ""),
    ("q_active_write", "gauge", ("globalLock/activeClients/writers",), ""),
    ("q_queued_read", "gauge", ("globalLock/currentQueue/readers",), ""),
    ("q_queued_write", "gauge", ("globalLock/currentQueue/writers",), ""),
    ("latency_read", "cum-ratio", ("opLatencies/reads/latency", "opLatencies/reads/ops"), "us_to_ms"),
    ("latency_write", "cum-ratio", ("opLatencies/writes/latency", "opLatencies/writes/ops"), "us_to_ms"),
    ("latency_command", "cum-ratio", ("opLatencies/commands/latency", "opLatencies/commands/ops"), "us_to_ms"),
    ("wt_cache_max", "gauge", ("wiredTiger/cache/maximum bytes configured",), "bytes_to_gb"),
    ("wt_cache_used", "gauge", ("wiredTiger/cache/bytes currently in the cache",), "bytes_to_gb"),
    ("wt_cache_dirty", "gauge", ("wiredTiger/cache/tracked dirty bytes in the cache",), "bytes_to_gb"),
    ("wt_dhandles_active", "gauge", ("wiredTiger/data-handle/connection data handles currently active",), ""),
    ("ticket_avail_read", "gauge", ("wiredTiger/concurrentTransactions/read/available",), ""),
    ("ticket_avail_write", "gauge", ("wiredTiger/concurrentTransactions/write/available",), ""),
    ("queues_read_out", "gauge", ("queues/execution/read/out",), ""),
    ("queues_read_available", "gauge", ("queues/execution/read/available",), ""),
    ("queues_read_total", "gauge", ("queues/execution/read/totalTickets",), ""),
    ("queues_write_out", "gauge", ("queues/execution/write/out",), ""),
    ("queues_write_available", "gauge", ("queues/execution/write/available",), ""),
    ("queues_write_total", "gauge", ("queues/execution/write/totalTickets",), ""),
    ("txn_active", "gauge", ("transactions/currentActive",), ""),
    ("txn_inactive", "gauge", ("transactions/currentInactive",), ""),
    ("txn_open", "gauge", ("transactions/currentOpen",), ""),
    ("tcmalloc_in_use", "gauge", ("tcmalloc/generic/bytes_in_use_by_app",), "bytes_to_gb"),
    ("tcmalloc_allocated", "gauge", ("tcmalloc/generic/current_allocated_bytes",), "bytes_to_gb"),
    ("tcmalloc_heap", "gauge", ("tcmalloc/generic/heap_size",), "bytes_to_gb"),
    ("tcmalloc_physical", "gauge", ("tcmalloc/generic/physical_memory_used",), "bytes_to_gb"),
    ("flowctl_rate_limit", "gauge", ("flowControl/targetRateLimit",), ""),
    ("mem_page_faults", "rate", ("extra_info/page_faults",), ""),
    ("conns_created/s", "rate", ("connections/totalCreated",), ""),
    ("net_in", "rate", ("network/bytesIn",), "bytes_to_mb"),
    ("net_out", "rate", ("network/bytesOut",), "bytes_to_mb"),
    ("net_requests", "rate", ("network/numRequests",), ""),
    ("net_physical_in", "rate", ("network/physicalBytesIn",), "bytes_to_mb"),
    ("net_physical_out", "rate", ("network/physicalBytesOut",), "bytes_to_mb"),
    ("ops_query", "rate", ("opcounters/query",), ""),
    ("ops_insert", "rate", ("opcounters/insert",), ""),
    ("ops_update", "rate", ("opcounters/update",), ""),
    ("ops_delete", "rate", ("opcounters/delete",), ""),
    ("ops_getmore", "rate", ("opcounters/getmore",), ""),
    ("ops_command", "rate", ("opcounters/command",), ""),
    ("scan_keys", "rate", ("metrics/queryExecutor/scanned",), ""),
    ("scan_objects", "rate", ("metrics/queryExecutor/scannedObjects",), ""),
    ("scan_sort", "rate", ("metrics/operation/scanAndOrder",), ""),
    ("query_targeting_keys", "delta-ratio", ("metrics/queryExecutor/scanned", "metrics/document/returned"), ""),
    ("query_targeting_objects", "delta-ratio", ("metrics/queryExecutor/scannedObjects", "metrics/document/returned"), ""),
    ("doc_returned/s", "rate", ("metrics/document/returned",), ""),
    ("doc_inserted/s", "rate", ("metrics/document/inserted",), ""),
    ("doc_updated/s", "rate", ("metrics/document/updated",), ""),
    ("doc_deleted/s", "rate", ("metrics/document/deleted",), ""),
    ("write_conflicts/s", "rate", ("metrics/operation/writeConflicts",), ""),
    ("wt_blkmgr_read", "rate", ("wiredTiger/block-manager/bytes read",), "bytes_to_mb"),
    ("wt_blkmgr_written", "rate", ("wiredTiger/block-manager/bytes written",), "bytes_to_mb"),
    ("wt_blkmgr_written_checkpoint", "rate", ("wiredTiger/block-manager/bytes written for checkpoint",), "bytes_to_mb"),
    ("wt_modified_evicted", "rate", ("wiredTiger/cache/modified pages evicted",), ""),
    ("wt_unmodified_evicted", "rate", ("wiredTiger/cache/unmodified pages evicted",), ""),
    ("wt_cache_read_in", "rate", ("wiredTiger/cache/bytes read into cache",), "bytes_to_mb"),
    ("wt_cache_written_from", "rate", ("wiredTiger/cache/bytes written from cache",), "bytes_to_mb"),
    ("txn_aborted/s", "rate", ("transactions/totalAborted",), ""),
    ("txn_committed/s", "rate", ("transactions/totalCommitted",), ""),
    ("txn_started/s", "rate", ("transactions/totalStarted",), ""),
    ("flowctl_acquiring_us", "rate", ("flowControl/timeAcquiringMicros",), ""),
    ("flowctl_lagged_count", "rate", ("flowControl/isLaggedCount",), ""),
)
#: Kinds that need no sample before.
GAUGES = ("gauge", "cum-ratio")
STATUS_PATHS = tuple(dict.fromkeys(p for _, _, paths, _ in STATUS_METRICS for p in paths))
CPU_METRICS = {"idle_ms": "cpu_idle", "iowait_ms": "cpu_iowait", "system_ms": "cpu_system", "user_ms": "cpu_user", "nice_ms": "cpu_nice", "steal_ms": "cpu_steal", "softirq_ms": "cpu_softirq"}
DISK_COUNTERS = ("read_time_ms", "write_time_ms", "io_queued_ms", "io_time_ms", "reads", "writes")


def status_columns() -> dict[str, str]:
    """Column name -> full path of the wide status record (for ``project_paths``)."""
    return {"ts_ms": "serverStatus/localTime", "uptime": "serverStatus/uptime", **{p: f"serverStatus/{p}" for p in STATUS_PATHS}}


def status_points(samples: DataFrame, metrics=STATUS_METRICS) -> DataFrame:
    """host, metric, entity, ts, seq, value of the catalogue's series, in one pass over the samples.

    ``samples`` has host, ts, seq, uptime and a column for each source path.
    """
    has_before = F.col("prev_ts").isNotNull()
    rows = [F.when(has_before | F.lit(kind in GAUGES), F.struct(F.lit(m).alias("metric"), _value(kind, ps, unit).alias("value"))) for m, kind, ps, unit in metrics]
    each = _guarded(samples, metrics).select("host", "ts", "seq", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x"))
    return each.select("host", "x.metric", F.lit("").alias("entity"), "ts", "seq", "x.value")


def _guarded(samples: DataFrame, metrics) -> DataFrame:
    return guarded(samples, list(dict.fromkeys(p for _, _, ps, _ in metrics for p in ps)))


def _value(kind: str, paths: tuple[str, ...], unit: str) -> Column:
    """A metric at a sample that has the sample before beside it."""
    here, before, scale = (lambda p: F.col(f"`{p}`")), (lambda p: F.col(f"`prev_{p}`")), F.lit(UNITS[unit])
    if kind == "gauge":
        return here(paths[0]).cast("double") / scale
    if kind == "cum-ratio":
        return F.when(here(paths[1]) > 0, ratio(here(paths[0]), here(paths[1])) / scale).otherwise(0.0)
    grown = [here(p) - before(p) for p in paths]
    if kind == "rate":
        return clamp0(grown[0]) / scale / F.col("seconds")
    return F.when(grown[1] > 0, clamp0(ratio(grown[0], grown[1]))).otherwise(0.0)


def status_series(samples: DataFrame, metrics=STATUS_METRICS) -> list[Wide]:
    """The series of ``status_points`` side by side: those with a point at every sample, and those that need a sample before. The values are stored, as they are read several times."""
    path = scratch(samples.sparkSession, "status")
    values = [_value(kind, ps, unit).cast("double").alias(f"v{i}") for i, (_, kind, ps, unit) in enumerate(metrics)]
    _guarded(samples, metrics).select("host", "ts", "seq", F.col("prev_ts").isNotNull().alias("grown"), *values).write.parquet(path)
    stored = samples.sparkSession.read.parquet(path)
    kinds = [tuple((m, "", F.col(f"v{i}")) for i, (m, kind, _, _) in enumerate(metrics) if (kind in GAUGES) == gauges) for gauges in (True, False)]
    return [Wide(rows, series) for rows, series in zip((stored, stored.where("grown")), kinds, strict=True) if series]


def cpu_points(samples: DataFrame) -> DataFrame:
    """The processor shares as series."""
    shares = share_of_delta(samples, list(CPU_METRICS))
    name = F.create_map(*(F.lit(x) for pair in CPU_METRICS.items() for x in pair))[F.col("metric")]
    return shares.select("host", name.alias("metric"), F.lit("").alias("entity"), "ts", "seq", "value")


def disk_points(samples: DataFrame) -> DataFrame:
    """The six series of each disk. ``samples`` has host, ts, seq, disk, the counters, io_in_progress, and ``sample``, the number of the host's sample."""
    found = previous(samples, [*DISK_COUNTERS, "sample"], ["host", "disk"])
    clock = previous(samples.select("host", "ts", "sample").distinct(), ["ts"], ["host"], ["ts", "sample"]).select("host", "sample", F.col("prev_ts").alias("clock"))
    joined = found.join(clock, ["host", "sample"]).where("sample > 0")
    grown = lambda c: F.col(c) - F.when(F.col("prev_sample") == F.col("sample") - 1, F.col(f"prev_{c}")).otherwise(0)
    seconds = F.greatest(F.lit(1.0), (F.unix_micros("ts") - F.unix_micros("clock")) / 1e6)
    values = {
        "disk_util": clamp0(grown("io_time_ms")) / 10, "disk_iops": clamp0(grown("reads") + grown("writes")) / seconds, "disks_queue_length": F.col("io_in_progress").cast("double"),
        "read_time_ms": clamp0(grown("read_time_ms")), "write_time_ms": clamp0(grown("write_time_ms")), "io_queued_ms": clamp0(grown("io_queued_ms")),
    }
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()))
    return joined.select("host", "disk", "ts", "seq", F.explode(rows).alias("x")).select("host", "x.metric", F.col("disk").alias("entity"), "ts", "seq", "x.value")


def lag_points(statuses: DataFrame) -> DataFrame:
    """Replication lag as series by member."""
    return replication_lag(statuses).select("host", F.lit("repl_lag").alias("metric"), "entity", "ts", F.lit(0).cast("bigint").alias("seq"), "value")


def merged(first: DataFrame, later: DataFrame) -> DataFrame:
    """Series of both tables; where both have a host's metric, those of ``later``."""
    named = later.select("host", "metric").distinct()
    return first.join(named, ["host", "metric"], "left_anti").unionByName(later)


def all_points(status: DataFrame, cpu: DataFrame | None = None, disks: DataFrame | None = None, replicas: DataFrame | None = None) -> DataFrame:
    """All series of all tables; of one name the last table's."""
    parts = [status_points(status)]
    parts += [make(t) for make, t in ((cpu_points, cpu), (disk_points, disks), (lag_points, replicas)) if t is not None]
    return reduce(merged, parts)
