"""Nested documents as numeric paths; delta-coded chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import running

#: Places in the order of a delta-coded column that are summed in one task.
STRETCH = 100_000


def _leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """An array of (path, value) of all numeric leaves below ``value``."""
    empty = F.array().cast("array<struct<path:string,value:bigint>>")
    leaf = lambda v, p=path: F.when(v.isNotNull(), F.array(F.struct(p.alias("path"), v.cast("bigint").alias("value")))).otherwise(empty)
    if isinstance(kind, T.BooleanType):
        return leaf(F.when(value, 1).otherwise(F.when(value.isNotNull(), 0)))
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return leaf(F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)))
    if isinstance(kind, T.NumericType):
        return leaf(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return leaf(F.unix_millis(value.cast("timestamp")))
    join = lambda p, name: F.when(p == "", name).otherwise(F.concat(p, F.lit("/"), name))
    if isinstance(kind, T.StructType):
        parts = [_leaves(value.getField(f.name), f.dataType, join(path, F.lit(f.name))) for f in kind.fields]
        return F.concat(empty, *parts)
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x, i: _leaves(x, kind.elementType, join(path, i.cast("string"))))
        return F.coalesce(F.flatten(each), empty)
    if isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(value), lambda e: _leaves(e["value"], kind.valueType, join(path, e["key"].cast("string"))))
        return F.coalesce(F.flatten(each), empty)
    return empty


def flatten_numeric(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """keys, path, value: the numeric leaves of a nested column.

    Steps are joined by ``/``, an array's index is a step, booleans are 0 or
    1, fractions are cut off, times are milliseconds; strings, nulls and other
    values are dropped.
    """
    kind = df.schema[column].dataType
    return df.select(*keys, F.explode(_leaves(F.col(column), kind, F.lit(""))).alias("x")).select(*keys, "x.path", "x.value")


def delta_decode(deltas: DataFrame, base: str, keys: Sequence[str], order: str, delta: str = "delta") -> DataFrame:
    """``deltas`` with ``value``: the base plus all deltas of its key up to the row; ``order`` is a whole number."""
    summed = running(deltas, F.col(delta), "__sum", keys, (order,), stretch=F.floor(F.col(order) / STRETCH))
    return summed.withColumn("value", F.col(base) + F.col("__sum")).drop("__sum")


def expand_zero_runs(tokens: DataFrame, run: str = "zeros", value: str = "delta") -> DataFrame:
    """Each row followed by as many copies as its ``zeros`` says; ``copy`` numbers them from 0."""
    return tokens.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(run), F.lit(0)).cast("long"))))


def explode_chunk(chunks: DataFrame, keys: Sequence[str], drop_last: bool = True) -> DataFrame:
    """keys, path, i, value: the samples of delta-coded chunks, without each chunk's last unless asked for."""
    kept = F.slice("values", F.lit(1), F.greatest(F.size("values") - (1 if drop_last else 0), F.lit(0)))
    return chunks.select(*keys, "path", F.posexplode(kept).alias("i", "value"))


def project_paths(samples: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """One row a sample with a column for each wanted path; a path that is absent reads 0."""
    wanted = samples.where(F.col("path").isin(*columns.values()))
    picked = [F.coalesce(F.max(F.when(F.col("path") == p, F.col("value"))), F.lit(0).cast("bigint")).alias(c) for c, p in columns.items()]
    return wanted.groupBy(*keys).agg(*picked)


DISK_PREFIX = "systemMetrics/disks/"
#: The counters of a disk, and those of the processors.
DISK_STATS = ("read_time_ms", "write_time_ms", "io_in_progress", "io_queued_ms", "io_time_ms", "reads", "writes")
CPU_STATS = ("idle_ms", "iowait_ms", "nice_ms", "softirq_ms", "steal_ms", "system_ms", "user_ms")


def project_disks(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a sample and disk with its seven counters."""
    steps = F.split(F.substr("path", F.lit(len(DISK_PREFIX) + 1)), "/")
    found = samples.where(F.col("path").startswith(DISK_PREFIX)).withColumns({"disk": steps[0], "stat": F.array_join(F.slice(steps, F.lit(2), F.size(steps)), "/")})
    picked = [F.coalesce(F.max(F.when(F.col("stat") == s, F.col("value"))), F.lit(0).cast("bigint")).alias(s) for s in DISK_STATS]
    return found.where(F.col("stat").isin(*DISK_STATS)).groupBy(*keys, "disk").agg(*picked)


def project_cpu(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a sample with the seven processor counters and the time of the sample."""
    return project_paths(samples, keys, {"ts_ms": "serverStatus/localTime", **{s: f"systemMetrics/cpu/{s}" for s in CPU_STATS}})


def optime_seconds(optime: Column) -> Column:
    """Seconds of an optime given as JSON text: {"ts": {"t": n}}, {"t": n}, {"$timestamp": {"t": n}}, or nested in ts; else 0."""
    number = lambda path: F.get_json_object(optime, path).try_cast("bigint")
    return F.coalesce(number("$.ts.t"), number("$.ts['$timestamp'].t"), number("$.ts.T"), number("$['$timestamp'].t"), number("$.t"), number("$.T"), F.lit(0).cast("bigint"))
