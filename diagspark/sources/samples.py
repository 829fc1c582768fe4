"""Reading JSON samples, server metadata, and stored series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_samples(spark: SparkSession, path: str, status: T.DataType | str, members: T.DataType | str) -> dict[str, DataFrame]:
    """``status``, ``replica`` and ``info`` tables of files whose lines come in cycles of three.

    The first line of a cycle is an array of statuses, the second of replica
    statuses; the third line of a file is its server information. A last line
    without a line end is dropped; rows carry file and line. A file of fewer
    than three lines has its first status' version as information. A file is one
    row while it is split, so it has to stay under 2 GB.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    complete = F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0)))
    lines = whole.select("file", F.posexplode(complete).alias("line", "text"))
    version = F.to_json(F.struct(F.struct(F.get_json_object(F.get(complete, F.lit(0)), "$[0].version").alias("Version")).alias("BuildInfo")))
    short = whole.select("file", F.when(F.size(complete) < 3, version).alias("text"), F.size(complete).alias("n")).where("n between 1 and 2").drop("n")
    kind = F.pmod("line", F.lit(3))
    array_of = lambda t: T.ArrayType(t) if isinstance(t, T.DataType) else f"array<{t}>"
    each = lambda rows, t: rows.select("file", "line", F.posexplode(F.from_json("text", array_of(t))).alias("position", "doc")).select("file", "line", "position", "doc.*")
    return {"status": each(lines.where(kind == 0), status), "replica": each(lines.where(kind == 1), members), "info": lines.where("line = 2").select("file", "text").union(short)}


def server_info(info: DataFrame, schema: T.DataType | str) -> DataFrame:
    """The last file's server information that is not null, as one row."""
    return info.where("text is not null").agg(F.max_by("text", "file").alias("text")).select(F.from_json("text", schema).alias("doc")).select("doc.*")


def member_samples(statuses: DataFrame, column: str = "members") -> DataFrame:
    """One row a member of each replica status."""
    return statuses.select("*", F.posexplode(column).alias("member_no", "member")).drop(column)


def save_points(points: DataFrame, path: str) -> None:
    """Write series as Parquet, in order of host, metric, entity and time; the path must not exist.

    Files are ranges of that order and grow with the bytes, not with the number
    of series, so a filter on host and metric (and a time range) leaves out all row
    groups but a few by their bounds, and by bloom filters.
    """
    order = [c for c in ("host", "metric", "entity", "ts", "seq") if c in points.columns]
    writer = points.repartitionByRange(*order).sortWithinPartitions(*order).write
    for column in ("host", "metric"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def load_points(spark: SparkSession, path: str, hosts: Sequence | None = None, metrics: Sequence[str] | None = None) -> DataFrame:
    """Stored series, of some hosts or metrics only if they are named."""
    found = spark.read.parquet(path)
    for column, wanted in (("host", hosts), ("metric", metrics)):
        if wanted is not None:
            found = found.where(F.col(column).isin(*wanted))
    return found
