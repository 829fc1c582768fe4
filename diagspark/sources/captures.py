"""Reading capture files: framed documents, the compressed ones holding delta-coded chunks."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CAPTURE_PREFIXES = ("metrics.",)
#: Bytes of chunks or samples that a batch holds, about.
_BATCH_BYTES = 1 << 20


def _batch(rows: list[tuple], names: list[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)


def _found(spark: SparkSession, inputs: str | Sequence[str], prefixes: Sequence[str]) -> DataFrame | None:
    """path, length, content of the capture files among inputs, as often as they are named; None if no input exists.

    The driver asks for each input whether it is there; what lies in folders is listed by Spark's tasks.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    named = []
    for name in dict.fromkeys([inputs] if isinstance(inputs, str) else inputs):
        try:
            path = fs.Path(name)
            matched = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        except Py4JJavaError:
            continue
        if matched is not None and len(matched):
            named.append(name)
    if not named:
        return None
    escaped = (re.sub(r"([\\*?\[\]{},^])", r"\\\1", p) for p in prefixes)
    pattern = "{" + ",".join(f"{p}*" for p in escaped) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(named)


def list_captures(spark: SparkSession, inputs: str | Sequence[str], prefixes: Sequence[str] = CAPTURE_PREFIXES) -> DataFrame:
    """path, length of the capture files among files and directly in folders, by path.

    A file, named or found, counts if its name begins with one of ``prefixes``;
    inputs that do not exist or cannot be read are left out, and one that is
    named twice counts once. An input may be a pattern of many folders or files.
    """
    found = _found(spark, inputs, prefixes)
    if found is None:
        return spark.createDataFrame([], "path string, length long")
    return found.select("path", "length").distinct().orderBy("path")


def latest(files: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` files by path."""
    return files.orderBy(F.col("path").desc()).limit(n).orderBy("path")


def _document(data: bytes, at: int = 0) -> Iterator[tuple[str, int, object]]:
    """(name, type, value) of a document's elements; nested documents as byte ranges."""
    (size,) = struct.unpack_from("<i", data, at)
    end, at = at + size - 1, at + 4
    fixed = {0x01: ("<d", 8), 0x09: ("<q", 8), 0x10: ("<i", 4), 0x12: ("<q", 8), 0x11: ("<Q", 8)}
    while at < end:
        kind = data[at]
        stop = data.index(b"\0", at + 1)
        name, at = data[at + 1 : stop].decode("utf-8", "replace"), stop + 1
        if kind in fixed:
            form, width = fixed[kind]
            yield name, kind, struct.unpack_from(form, data, at)[0]
        elif kind == 0x08:
            width = 1
            yield name, kind, data[at]
        elif kind in (0x03, 0x04):
            (width,) = struct.unpack_from("<i", data, at)
            yield name, kind, data[at : at + width]
        elif kind in (0x02, 0x0D, 0x0E):
            (n,) = struct.unpack_from("<i", data, at)
            width = 4 + n
            yield name, kind, data[at + 4 : at + 3 + n].decode("utf-8", "replace")
        elif kind == 0x05:
            (n,) = struct.unpack_from("<i", data, at)
            width = 5 + n
            yield name, kind, data[at + 5 : at + 5 + n]
        elif kind in (0x06, 0x0A, 0xFF, 0x7F):
            width = 0
        elif kind == 0x07:
            width = 12
        elif kind == 0x13:
            width = 16
        elif kind == 0x0B:
            width = data.index(b"\0", data.index(b"\0", at) + 1) + 1 - at
        else:
            raise ValueError(f"a document has an element of unknown type {kind}")
        at += width


def numeric_paths(data: bytes, prefix: str = "") -> Iterator[tuple[str, int]]:
    """(path, value) of a document's numeric leaves in order; a timestamp gives two."""
    for name, kind, value in _document(data):
        path = f"{prefix}/{name}" if prefix else name
        if kind in (0x03, 0x04):
            yield from numeric_paths(value, path)
        elif kind == 0x11:
            yield f"{path}/t", value >> 32
            yield f"{path}/i", value & 0xFFFFFFFF
        elif kind in (0x01, 0x08, 0x09, 0x10, 0x12):
            yield path, int(value)


def _varints(data: bytes) -> np.ndarray:
    """The whole variable-length numbers of ``data``, seven bits a byte from the lowest, modulo 2^64; one that is cut off is left out."""
    octets = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(octets < 0x80)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    octets = octets[: ends[-1] + 1]
    place = np.arange(len(octets)) - np.repeat(starts, ends - starts + 1)
    bits = (octets & 0x7F).astype(np.uint64) << (7 * np.minimum(place, 9)).astype(np.uint64)
    return np.add.reduceat(np.where(place < 10, bits, np.uint64(0)), starts)


def _deltas(tokens: np.ndarray, wanted: int) -> np.ndarray:
    """The first ``wanted`` deltas: a zero is followed by how many more zeros come; what is missing reads as 0."""
    zero = tokens == 0
    place = np.arange(len(tokens))
    after = np.concatenate(([0], np.maximum.accumulate(np.where(zero, 0, place + 1))[:-1])) if len(tokens) else place
    # Zeros that follow each other are by turns a delta and its number; so is what ends them.
    number = (place - after) % 2 == 1
    more = np.zeros(len(tokens), np.int64)
    more[:-1] = np.where(zero[:-1] & ~number[:-1], np.minimum(tokens[1:], np.uint64(wanted)).astype(np.int64), 0)
    kept = np.flatnonzero(~number)
    kept = kept[: np.searchsorted(np.cumsum(1 + more[kept]), wanted) + 1]
    found = np.repeat(tokens[kept], 1 + more[kept])[:wanted]
    return np.concatenate((found, np.zeros(wanted - len(found), np.uint64)))


def decode_chunk(data: bytes) -> dict[str, np.ndarray]:
    """path -> samples of one compressed chunk: the first document's values and all deltas; of duplicate paths the first counts."""
    raw = zlib.decompress(data[4:])
    (size,) = struct.unpack_from("<I", raw)
    count, deltas = struct.unpack_from("<II", raw, size)
    paths = list(numeric_paths(raw[:size]))
    if len(paths) != count:
        raise ValueError("a chunk has another number of counters than it says")
    first = np.array([v & (1 << 64) - 1 for _, v in paths], np.uint64).reshape(-1, 1)
    grown = _deltas(_varints(raw[size + 8 :]), count * deltas).reshape(count, deltas)
    columns = np.cumsum(np.hstack((first, grown)), axis=1, dtype=np.uint64).view(np.int64)
    return {path: columns[i] for i, (path, _) in reversed(list(enumerate(paths)))}


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(number of chunks before, type, body) of a capture's framed documents: type 0 the metadata document, 1 a compressed chunk."""
    at = number = 0
    while at < len(data):
        if at + 4 > len(data) or at + (size := struct.unpack_from("<I", data, at)[0]) > len(data) or size < 5:
            raise ValueError("a capture ends inside a document")
        found = {name: value for name, _, value in _document(data[at : at + size])}
        body = found.get("doc") if found.get("type") == 0 else found.get("data")
        if found.get("type") in (0, 1) and isinstance(body, bytes):
            yield number, found["type"], body
            number += found["type"]
        at += size


def _binary(spark: SparkSession, inputs: str | Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """path, content of the capture files among the inputs, each once."""
    found = _found(spark, inputs, prefixes)
    if found is None:
        return spark.createDataFrame([], "path string, content binary")
    if not found.groupBy("path").count().where("count > 1").isEmpty():  # inputs that overlap
        found = spark.read.format("binaryFile").load([r["path"] for r in found.select("path").distinct().collect()])
    return found.select("path", "content")


def _tasks(spark: SparkSession) -> int:
    """Number of tasks for work that the size of its rows says little about; adaptive execution leaves a given number as it is."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_captures(spark: SparkSession, inputs: str | Sequence[str], paths: Sequence[str] | None = None, mode: str = "FAILFAST", prefixes: Sequence[str] = CAPTURE_PREFIXES) -> DataFrame:
    """file, chunk_no, path, values array<bigint>, _corrupt of every chunk in the captures of files and folders.

    ``paths`` keeps only some counters. A chunk that cannot be read fails the
    job, or with ``mode='DROPMALFORMED'`` gives a row whose _corrupt says why.
    """
    files = _binary(spark, inputs, prefixes)
    wanted = set(paths) if paths is not None else None
    strict = mode == "FAILFAST"

    frame_names = ["file", "chunk_no", "data", "_corrupt"]
    frame_types = (pa.string(), pa.int32(), pa.binary(), pa.string())

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows = [(file, n, body, None) for n, kind, body in frames(content.as_py()) if kind == 1]
                except (ValueError, struct.error) as e:
                    if strict:
                        raise
                    rows = [(file, -1, None, str(e))]
                for row in rows:
                    out.append(row)
                    size += len(row[2] or b"")
                    if size >= _BATCH_BYTES:
                        yield _batch(out, frame_names, frame_types)
                        out, size = [], 0
        yield _batch(out, frame_names, frame_types)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "chunk_no", "path", "values", "_corrupt"]
        types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.string())
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for file, number, data, corrupt in zip(*(batch.column(c) for c in frame_names), strict=True):
                file, number, before = file.as_py(), number.as_py(), len(out)
                if not data.is_valid:
                    out.append((file, number, None, None, corrupt.as_py()))
                else:
                    try:
                        out += [(file, number, p, v, None) for p, v in decode_chunk(data.as_py()).items() if wanted is None or p in wanted]
                    except (ValueError, struct.error, zlib.error) as e:
                        if strict:
                            raise
                        out.append((file, number, None, None, str(e)))
                    else:
                        size += sum(v.nbytes for _, _, _, v, _ in out[before:])
                if size >= _BATCH_BYTES:
                    yield _batch(out, names, types)
                    out, size = [], 0
            yield _batch(out, names, types)

    chunks = files.mapInArrow(framed, "file string, chunk_no int, data binary, _corrupt string")
    # Chunks of one large file are decoded in many tasks.
    dealt = chunks.repartition(_tasks(spark), "file", "chunk_no")
    return dealt.mapInArrow(decoded, "file string, chunk_no int, path string, values array<bigint>, _corrupt string")


def load_captures(spark: SparkSession, inputs: str | Sequence[str], path: str, paths: Sequence[str] | None = None, prefixes: Sequence[str] = CAPTURE_PREFIXES) -> dict[str, object]:
    """Write the samples of all captures that can be read whole, as Parquet; then say what went wrong.

    A file with a chunk that cannot be read is left out. The result has
    ``failed_chunks``, and ``last_file`` and ``last_error`` of the last such
    file by name (None if all are good), taken from the run that decodes, so
    nothing is read twice.
    """
    seen = Observation("captures")
    why = F.when(F.col("_corrupt").isNotNull(), F.struct("file", F.col("_corrupt").alias("error")))
    chunks = read_captures(spark, inputs, paths, "DROPMALFORMED", prefixes)
    chunks.observe(seen, F.count("_corrupt").alias("failed"), F.max(why).alias("last")).write.parquet(f"{path}/chunks")
    whole = spark.read.parquet(f"{path}/chunks")
    bad = whole.where("_corrupt is not null").select("file").distinct()
    whole.join(bad, "file", "left_anti").drop("_corrupt").write.parquet(f"{path}/samples")
    last = seen.get["last"]
    return {"failed_chunks": seen.get["failed"], "last_file": last and last["file"], "last_error": last and last["error"]}


def _json(data: bytes, is_list: bool = False) -> object:
    """A document as objects and lists of Python; times are milliseconds, identifiers and bytes are in hex."""
    out: list[tuple[str, object]] = []
    for name, kind, value in _document(data):
        if kind in (0x03, 0x04):
            out.append((name, _json(value, kind == 0x04)))
        elif kind == 0x08:
            out.append((name, bool(value)))
        elif kind == 0x11:
            out.append((name, {"t": value >> 32, "i": value & 0xFFFFFFFF}))
        elif isinstance(value, bytes):
            out.append((name, value.hex()))
        else:
            out.append((name, value))
    return [v for _, v in out] if is_list else dict(reversed(out))


def capture_documents(spark: SparkSession, inputs: str | Sequence[str], prefixes: Sequence[str] = CAPTURE_PREFIXES) -> DataFrame:
    """file, position, kind, document, _corrupt: the plain documents of captures as JSON text.

    ``kind`` is ``metadata`` for a metadata document and ``sample`` for the
    first document of a chunk, which holds the names and texts that the chunk's
    samples share. A file that cannot be read gives a row whose _corrupt says why.
    """
    files = _binary(spark, inputs, prefixes)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                try:
                    for position, (_, kind, body) in enumerate(frames(content.as_py())):
                        if kind == 1:
                            raw = zlib.decompress(body[4:])
                            body = raw[: struct.unpack_from("<I", raw)[0]]
                        rows.append((file, position, "sample" if kind else "metadata", json.dumps(_json(body)), None))
                except (ValueError, struct.error, zlib.error) as e:
                    rows = [(file, -1, None, None, str(e))]
                if rows:
                    columns = zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["file", "position", "kind", "document", "_corrupt"])

    return files.mapInArrow(told, "file string, position int, kind string, document string, _corrupt string")
