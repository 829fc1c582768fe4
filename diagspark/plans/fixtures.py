"""Files made of the test tables, for the registered queries that read files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .scratch import scratch

COUNTERS = ("host", "seq", "cents")


def _document(*elements: tuple[str, int, bytes]) -> bytes:
    body = b"".join(bytes([kind]) + name.encode() + b"\0" + value for name, kind, value in elements)
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _capture_document(columns: list[list[int]], broken: bool) -> bytes:
    """A framed chunk of the samples of COUNTERS; a broken one says that it has a counter more."""
    first = _document(("sample", 0x03, _document(*((n, 0x12, struct.pack("<q", c[0])) for n, c in zip(COUNTERS, columns, strict=True)))))
    coded, zeros = bytearray(), 0
    for delta in (b - a for c in columns for a, b in zip(c, c[1:], strict=False)):
        if delta and zeros:
            coded += b"\0" + _varint(zeros - 1)
        if delta:
            coded += _varint(delta & (1 << 64) - 1)
        zeros = 0 if delta else zeros + 1
    if zeros:
        coded += b"\0" + _varint(zeros - 1)
    raw = first + struct.pack("<II", len(columns) + broken, len(columns[0]) - 1) + coded
    data = struct.pack("<I", len(raw)) + zlib.compress(raw)
    return _document(("type", 0x10, struct.pack("<i", 1)), ("data", 0x05, struct.pack("<i", len(data)) + b"\0" + data))


def capture_files(spark: SparkSession, sf_dir: str, broken: Column | None = None) -> str:
    """A folder of capture files, one a user: a chunk of ``events`` a day; where ``broken`` holds for the host its chunks cannot be read."""
    days = V.events(spark, sf_dir).groupBy(F.col("user_id").alias("host"), F.to_date("ts").alias("day"))
    samples = days.agg(F.array_sort(F.collect_list(F.struct("event_id", "cents"))).alias("samples"))
    rows = samples.select("host", F.col("samples.event_id").alias("seq"), F.col("samples.cents").alias("cents"), (F.lit(False) if broken is None else broken).alias("broken"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_capture_document([[r["host"]] * len(r["seq"]), r["seq"], r["cents"]], r["broken"]) for r in batch.to_pylist()]
            # A document ends in a zero byte, which the text writer puts after each row.
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([m[:-1] for m in made], pa.binary())], ["host", "document"])

    path = scratch(spark, "captures")
    # Chunks and files cost by number, not by bytes: they are dealt to a given number of tasks, and each task moves its own files to their place.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "host")
    values = dealt.mapInArrow(coded, "host long, document binary").select("host", F.col("document").cast("string").alias("value"))
    values.write.partitionBy("host").option("lineSep", "\0").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return path


def text_tree(rows: DataFrame, name: str, folder: str, broken: Column) -> str:
    """A tree of files of lines (the column ``value``), a folder for each value of ``folder``; where ``broken`` holds the lines are cut short."""
    path = scratch(rows.sparkSession, name)
    cut = F.when(broken, F.substr("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    rows.select(folder, cut.alias("value")).repartition(folder).write.partitionBy(folder).text(path)
    return path


def json_tree(rows: DataFrame, name: str, folder: str, broken: Column) -> str:
    """A tree of JSON-lines files of the rows, as ``text_tree``."""
    text = F.to_json(F.struct(*(c for c in rows.columns if c != folder)))
    return text_tree(rows.select(folder, text.alias("value")), name, folder, broken)
