"""The series query surface: catalogue, select, host information, panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import short_label
from .series import MAX_POINTS, SERIES, downsample, slice_range

#: Targets whose stored series have another name.
STORED = {"replication_lags": "repl_lag", "disks_utils": "disk_util", "disks_iops": "disk_iops"}
#: Targets that give a series for each disk or host.
FAN_OUT = ("replication_lags", "disks_utils", "disks_iops", "disks_queue_length", "read_time_ms", "write_time_ms", "io_queued_ms")
DISK_PANELS = ("disks_iops", "disks_utils", "disks_queue_length", "read_time_ms", "write_time_ms", "io_queued_ms", "latency_read", "latency_write", "latency_command", "cpu_iowait", "cpu_user")


def catalogue(points: DataFrame) -> DataFrame:
    """The names that can be asked for."""
    spark = points.sparkSession
    return points.select("metric").distinct().union(spark.createDataFrame([("host_info",)], "metric string")).distinct()


def select_series(points: DataFrame, targets: Sequence[str], start: Column, end: Column, max_points: int = MAX_POINTS) -> DataFrame:
    """host, target, entity, ts, value of the wanted series over a range, downsampled; fan-out targets are named by entity, others by short label."""
    stored = lambda names: [STORED.get(t, t) for t in names]
    wanted = points.where(F.col("metric").isin(*stored(targets)))
    cut = downsample(slice_range(wanted, start, end), max_points)
    name = F.when(F.col("metric").isin(*stored(FAN_OUT)), F.col("entity")).otherwise(short_label(F.col("metric")))
    return cut.select(*SERIES, name.alias("target"), "ts", "value")


def panel_disks(points: DataFrame, start: Column, end: Column) -> DataFrame:
    return select_series(points, DISK_PANELS, start, end)


def storage_size(number: Column) -> Column:
    """Bytes in the largest unit of which there is one at least, with one decimal; a tie goes to the even digit."""
    number = number.cast("bigint")
    whole = lambda a, b: ((a - a % b) / b).cast("bigint")
    out = F.format_string("%.0f", number.cast("double"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        size = 1024**power
        rest = number % size * 10  # in whole numbers: format_string rounds ties up
        digit, twice = whole(rest, size), rest % size * 2
        up = (twice > size) | ((twice == size) & (digit % 2 == 1))
        tenths = whole(number, size) * 10 + digit + F.when(up, 1).otherwise(0)
        text = F.concat(whole(tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))
        out = F.when(number >= size, text).otherwise(out)
    return out


def host_info(info: DataFrame, verbose: bool = False) -> DataFrame:
    """host, position, text: what is known of each host, a line each."""
    lines = [
        F.concat(F.lit("version "), "version"), F.concat(F.lit("CPU: "), F.col("num_cores").cast("string"), F.lit(" cores ("), "cpu_arch", F.lit(")")),
        *([F.concat(F.lit("Host: "), "hostname")] if verbose else []), F.concat(F.lit("Memory: "), storage_size(F.col("mem_size_mb").cast("bigint") * 1048576)),
        F.concat("os_type", F.lit(" ("), "os_version", F.lit(")")), F.col("os_name"),
    ]
    return info.select("host", F.posexplode(F.array(*lines)).alias("position", "text"))
