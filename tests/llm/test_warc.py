import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from diagspark.llm import warc as W

LONG = "<p>" + "x" * 200_000 + "ÄÖ漢</p>"
ROWS = [
    (5, "http://a/1", LONG), (2, "http://a/2", LONG), (9, None, LONG), (9, None, LONG), (2, "http://a/2", LONG), (None, "http://n/", LONG),
    (1, "http://b/", "short"), (3, "http://b/", "short"), (4, "http://c/\r\nInjected: x", None), (6, "http://c/", ""),
    (7, "http://d/", "WARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 5\r\n\r\n" * 5), (8, "http://d/", "\r\n\r\n" + "y" * 120 + "\r\n\r\n"),
    (10, "u", "\r\n\r\n" + "y" * 120 + "\r\n\r\n"), (11, "u", "﻿" + "\x00\x1f\n\n" * 40), (None, None, None), (12, "u", "z" * 99), (13, "u", "z" * 99),
    (14, "u", "é" * 50), (15, "u", "é" * 50),
]


def want(rows):
    least = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            least[data] = min(page, least.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = least.get(data) if len(data) >= 100 else None
        again = first is not None and first != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, record_type string, payload int").repartition(3)


def test_round_trip_of_awkward_rows(spark):
    assert Counter(tuple(r) for r in W.warc_round_trip(pages(spark, ROWS)).collect()) == want(ROWS)


def test_round_trip_of_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in table.select("page_id", "url", "html").collect()]
    assert Counter(tuple(r) for r in W.warc_round_trip(table).collect()) == want(rows)


def test_archives_are_valid_records(spark, tmp_path):
    """Any reader that follows Content-Length finds the same records, and repeated payloads are stored once."""
    mark = W.write_warc(pages(spark, ROWS).drop("record_type", "payload"), f"{tmp_path}/w")
    found = []
    for file in (tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n") and b"\nInjected" not in head
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            found.append((fields[b"WARC-Type"], rest[len(W.HTTP) : size]))
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
    assert len(found) == len(ROWS)
    assert sum(LONG.encode() in body for _, body in found) == 2  # page 2 occurs twice
    assert all(body == b"" for kind, body in found if kind == b"revisit")
    assert W.read_warc(spark, f"{tmp_path}/w", mark).count() == len(ROWS)


def test_wrong_length_fails(spark, tmp_path):
    bad = W._boundary("m") + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabcdef"
    spark.createDataFrame([(bad,)], "value string").write.option("lineSep", "\r\n\r\n").text(f"{tmp_path}/w")
    with pytest.raises(Exception, match="Content-Length"):
        W.read_warc(spark, f"{tmp_path}/w", "m").collect()


def test_empty_table(spark):
    assert W.warc_round_trip(pages(spark, ROWS).where(F.lit(False))).collect() == []
