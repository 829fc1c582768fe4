"""Capture files and JSON samples made by hand."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from diagspark.operators.nested import explode_chunk, project_paths
from diagspark.sources import captures as S
from diagspark.sources import samples as J


def document(*elements):
    body = b""
    for name, kind, value in elements:
        body += bytes([kind]) + name.encode() + b"\0"
        if kind == 0x12 or kind == 0x09:
            body += struct.pack("<q", value)
        elif kind == 0x10:
            body += struct.pack("<i", value)
        elif kind == 0x01:
            body += struct.pack("<d", value)
        elif kind == 0x08:
            body += bytes([value])
        elif kind == 0x11:
            body += struct.pack("<II", value[1], value[0])
        elif kind == 0x02:
            body += struct.pack("<i", len(value) + 1) + value.encode() + b"\0"
        elif kind in (0x03, 0x04):
            body += value
        elif kind == 0x05:
            body += struct.pack("<i", len(value)) + b"\0" + value
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def varint(n):
    out = b""
    while n >= 0x80:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def chunk(first, columns):
    """A compressed chunk: the first document and the deltas of each counter, zeros in runs across counters."""
    deltas = [(b - a) % (1 << 64) for column in columns for a, b in zip(column, column[1:], strict=False)]
    raw, i = b"", 0
    while i < len(deltas):
        if deltas[i]:
            raw += varint(deltas[i])
            i += 1
        else:
            run = next((k for k in range(i, len(deltas)) if deltas[k]), len(deltas)) - i
            raw += b"\0" + varint(run - 1)
            i += run
    data = first + struct.pack("<II", len(columns), len(columns[0]) - 1) + raw
    return struct.pack("<I", len(data)) + zlib.compress(data)


FIRST = document(("serverStatus", 3, document(("uptime", 0x12, 5), ("ok", 0x08, 1), ("name", 0x02, "x"), ("when", 0x11, (7, 3)), ("f", 0x01, 2.9))), ("list", 4, document(("0", 0x10, 4))), ("list", 4, document(("0", 0x10, 9))))
COLUMNS = [[5, 6, 7, 8], [1, 1, 1, 1], [7, 7, 7, 7], [3, 3, 2, 1], [2, 2, 2, 302], [4, 4, 4, 5], [9, 9, 9, 9]]
PATHS = ["serverStatus/uptime", "serverStatus/ok", "serverStatus/when/t", "serverStatus/when/i", "serverStatus/f", "list/0", "list/0"]


def capture(*chunks):
    meta = document(("type", 0x10, 0), ("doc", 3, document(("v", 0x02, "1"))))
    return meta + b"".join(document(("type", 0x10, 1), ("data", 5, c)) for c in chunks) + document(("type", 0x10, 2))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "metrics.b").write_bytes(capture(chunk(FIRST, COLUMNS), chunk(FIRST, COLUMNS)))
    (tmp_path / "metrics.a").write_bytes(capture(chunk(FIRST, COLUMNS)))
    (tmp_path / "other.c").write_bytes(b"not a capture")
    return str(tmp_path)


def test_files(spark, folder):
    assert [r["path"].rsplit("/", 1)[1] for r in S.list_captures(spark, folder).collect()] == ["metrics.a", "metrics.b"]
    assert [r["path"].rsplit("/", 1)[1] for r in S.latest(S.list_captures(spark, folder), 1).collect()] == ["metrics.b"]


def test_chunks(spark, folder):
    rows = S.read_captures(spark, folder).collect()
    assert len(rows) == 3 * 6  # a path that comes twice counts once
    for r in rows:
        assert r["values"] == COLUMNS[PATHS.index(r["path"])] and r["_corrupt"] is None
    assert {(r["file"].rsplit("/", 1)[1], r["chunk_no"]) for r in rows} == {("metrics.a", 0), ("metrics.b", 0), ("metrics.b", 1)}
    some = S.read_captures(spark, folder, paths=["serverStatus/uptime"])
    long = explode_chunk(some, ["file", "chunk_no"])
    assert long.count() == 3 * 3
    wide = project_paths(long, ["file", "chunk_no", "i"], {"uptime": "serverStatus/uptime", "absent": "serverStatus/none"}).where("i = 2").collect()
    assert {(r["uptime"], r["absent"]) for r in wide} == {(7, 0)}


def test_broken_captures(spark, tmp_path):
    (tmp_path / "metrics.1").write_bytes(capture(chunk(FIRST, COLUMNS))[:-9])
    (tmp_path / "metrics.2").write_bytes(capture(chunk(FIRST, COLUMNS[:-1]), chunk(FIRST, COLUMNS)))
    with pytest.raises(Exception, match="inside a document|another number"):
        S.read_captures(spark, str(tmp_path)).collect()
    rows = S.read_captures(spark, str(tmp_path), mode="DROPMALFORMED").collect()
    assert len([r for r in rows if r["_corrupt"]]) == 2 and len([r for r in rows if r["path"]]) == 6


def test_json_samples(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"host":"x","uptime":1},{"host":"x","uptime":2}]\n[{"members":[{"name":"m","state":1}]}]\n{"version":"7"}\n[{"host":"x","uptime":3}]\n[]\n{"version":"8"}\n[{"host":"cut","uptime":9}]')
    found = J.read_json_samples(spark, str(tmp_path), "struct<host:string,uptime:long>", "struct<members:array<struct<name:string,state:int>>>")
    assert sorted(r["uptime"] for r in found["status"].collect()) == [1, 2, 3]
    assert J.member_samples(found["replica"]).select("member.name").collect() == [("m",)]
    assert J.server_info(found["info"], "struct<version:string>").collect() == [("7",)]


def test_stored_points_grow_by_bytes_and_are_pruned(spark, tmp_path):
    import pyarrow.parquet as pq

    points = spark.range(60_000).select((F.col("id") % 20).cast("string").alias("host"), F.concat(F.lit("m"), F.col("id") % 30).alias("metric"), F.lit("").alias("entity"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.rand(1).alias("value"))
    J.save_points(points, f"{tmp_path}/p")
    files = sorted((tmp_path / "p").glob("*.parquet"))
    assert len(files) <= 8  # not one for each of 60 series
    read = J.load_points(spark, f"{tmp_path}/p", hosts=["7"], metrics=["m17"])
    assert read.count() == 1000
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(host, [7]), In(metric, [m17])" in plan or "EqualTo(host,7)" in plan
    # Ranges of row groups do not overlap in host, but at their edges.
    bounds = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        bounds += [(c.statistics.min, c.statistics.max) for g in range(meta.num_row_groups) for c in [meta.row_group(g).column(0)]]
    assert sum(low <= "7" <= high for low, high in bounds) <= 2
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        J.save_points(points, f"{tmp_path}/p")


def test_inputs_may_be_files_folders_and_missing(spark, folder, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "metrics.z").write_bytes(capture(chunk(FIRST, COLUMNS)))
    (tmp_path / "metrics.folder").mkdir()
    names = lambda inputs: [r["path"].rsplit("/", 1)[1] for r in S.list_captures(spark, inputs).collect()]
    assert names([f"{folder}/sub", f"{folder}/none", f"{folder}/metrics.b", f"{folder}/other.c"]) == ["metrics.b", "metrics.z"]
    assert names([folder, f"{folder}/metrics.a"]) == ["metrics.a", "metrics.b"]
    assert names([f"{folder}/none"]) == [] and S.read_captures(spark, f"{folder}/none").collect() == []
    assert S.read_captures(spark, [f"{folder}/sub", f"{folder}/metrics.a"], ["serverStatus/uptime"]).count() == 2


def test_many_folders_are_named_by_a_pattern(spark, tmp_path):
    for host in range(3):
        (tmp_path / f"host={host}").mkdir()
        (tmp_path / f"host={host}" / "metrics.1").write_bytes(capture(chunk(FIRST, COLUMNS)))
        (tmp_path / f"host={host}" / "metricsX1").write_bytes(b"not a capture")
    inputs = [f"{tmp_path}/host=*", f"{tmp_path}/host=1/metrics.1", f"{tmp_path}/none=*"]
    assert [r["path"].split("host=")[1] for r in S.list_captures(spark, inputs).collect()] == [f"{h}/metrics.1" for h in range(3)]
    assert S.read_captures(spark, inputs, ["serverStatus/uptime"]).count() == 3


def test_decoding_has_as_many_tasks_as_shuffles(spark, folder):
    # Chunks are small and slow to decode, so their bytes must not decide how many tasks there are.
    assert S.read_captures(spark, folder).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_good_captures_are_loaded_and_the_last_error_told(spark, folder, tmp_path):
    (tmp_path / "metrics.c").write_bytes(capture(chunk(FIRST, COLUMNS), chunk(FIRST, COLUMNS[:-1])))
    (tmp_path / "metrics.aa").write_bytes(capture(chunk(FIRST, COLUMNS))[:-9])
    told = S.load_captures(spark, folder, f"{tmp_path}/out")
    assert told["failed_chunks"] == 2 and told["last_file"].endswith("metrics.c") and "another number" in told["last_error"]
    kept = spark.read.parquet(f"{tmp_path}/out/samples")
    assert {r["file"].rsplit("/", 1)[1] for r in kept.select("file").distinct().collect()} == {"metrics.a", "metrics.b"} and kept.count() == 18
    (tmp_path / "metrics.c").unlink()
    (tmp_path / "metrics.aa").unlink()
    assert S.load_captures(spark, folder, f"{tmp_path}/out2") == {"failed_chunks": 0, "last_file": None, "last_error": None}


def test_captures_without_clear_names(spark, tmp_path):
    from diagspark.operators.documents import redact_captures

    first = document(("host", 0x02, "db1.example.com"), ("uptime", 0x12, 5), ("repl", 3, document(("setName", 0x02, "rs-main"), ("hosts", 4, document(("0", 0x02, "10.0.0.7"))))))
    meta = document(("type", 0x10, 0), ("doc", 3, document(("hostInfo", 3, document(("hostname", 0x02, "db1.example.com"), ("memSizeMB", 0x10, 512), ("up", 0x08, 1))))))
    good = meta + document(("type", 0x10, 1), ("data", 5, chunk(first, [[5, 6, 7]])))
    (tmp_path / "metrics.1").write_bytes(good)
    (tmp_path / "metrics.2").write_bytes(good[:-3])
    bad = redact_captures(spark, str(tmp_path), f"{tmp_path}/out").collect()
    assert len(bad) == 1 and bad[0]["file"].endswith("metrics.2")
    rows = spark.read.parquet(f"{tmp_path}/out/documents").orderBy("position").collect()
    told = " ".join(r["document"] for r in rows)
    assert [r["kind"] for r in rows] == ["metadata", "sample"] and "example.com" not in told and "rs-main" not in told and "10.0.0.7" not in told
    assert '"memSizeMB":512' in told and '"up":true' in told and '"hostname":"host-' in told
    samples = spark.read.parquet(f"{tmp_path}/out/samples").collect()
    assert [(r["path"], r["values"]) for r in samples] == [("uptime", [5, 6, 7])]


def test_short_file_tells_its_version(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"version": "7.0.1", "uptime": 5}]\n')
    found = J.read_json_samples(spark, str(tmp_path), "struct<version: string, uptime: bigint>", "struct<name: string>")
    assert [r["version"] for r in found["status"].collect()] == ["7.0.1"]
    assert J.server_info(found["info"], "BuildInfo struct<Version string>").first()["BuildInfo"]["Version"] == "7.0.1"


def test_decoding_equals_a_plain_walk():
    import random

    rng = random.Random(5)
    for length in (1, 2, 3, 40):
        for _ in range(50):
            step = lambda: rng.choice((0, 0, 0, 1, -1, 127, 128, 1 << 40, -(1 << 62)))
            columns = []
            for first in (5, 1, 7, 3, 2, 4, 9):
                column = [first]
                for _ in range(length - 1):
                    column.append((column[-1] + step() + (1 << 63)) % (1 << 64) - (1 << 63))
                columns.append(column)
            found = S.decode_chunk(chunk(FIRST, columns))
            assert {p: v.tolist() for p, v in found.items()} == {p: columns[PATHS.index(p)] for p in found} and len(found) == 6


def test_cut_off_deltas_read_as_zero():
    data = FIRST + struct.pack("<II", 7, 2) + varint(3) + b"\0" + varint(1) + b"\x85"
    found = S.decode_chunk(struct.pack("<I", len(data)) + zlib.compress(data))
    assert found["serverStatus/uptime"].tolist() == [5, 8, 8] and found["serverStatus/ok"].tolist() == [1, 1, 1] and found["list/0"].tolist() == [4, 4, 4]


def test_redacted_tree(spark, tmp_path):
    from pyspark.sql.types import StructType

    from diagspark.operators.redact import redact_tree

    for name, lines in (("a/x.json", '{"host":"db1.example.com","n":1}\n\n{"n":2}\n'), ("b/c/y.json", '{"host":"db1.example.com","n":3}\n{"host":\n'), ("z.json", "")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(lines)
    skipped = redact_tree(spark, f"{tmp_path}/in", StructType().add("host", "string").add("n", "long"), f"{tmp_path}/out")
    assert [(r["file"].rsplit("/", 1)[1], r["bad_lines"]) for r in skipped.collect()] == [("y.json", 1)]
    rows = {r["n"]: r["host"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows.keys() == {1, 2} and rows[1].startswith("host-") and rows[2] is None
