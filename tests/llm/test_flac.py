import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from diagspark.llm import flac as M

from . import cases


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - j) & 1 for j in range(n)]

    def data(self):
        return np.packbits(self.bits).tobytes()


def by_hand(channels, samples, subframe, width, assignment, total):
    """A stream of one frame without a seek table, from hand-made subframes."""
    head = bytes([0xFF, 0xF8, 0b0111 << 4 | 0b0100, assignment << 4 | {8: 1, 16: 4}[width] << 1, 0]) + struct.pack(">H", total - 1)
    head += bytes([M.crc8(head)])
    w = Writer()
    subframe(w)
    body = head + w.data()
    info = struct.pack(">HH", total, total) + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (width - 1) << 36 | total).to_bytes(8, "big")
    pcm = b"".join(int(v).to_bytes(width // 8, "little", signed=True) for row in np.array(samples).T for v in row)
    return b"fLaC\x80" + (34).to_bytes(3, "big") + info + hashlib.md5(pcm).digest() + body + struct.pack(">H", int(M.crc16_of([body])[0])), pcm


def rice(w, e, k):
    u = e << 1 if e >= 0 else -e * 2 - 1
    w.put(0, u >> k)
    w.put(1, 1)
    w.put(u & ((1 << k) - 1), k)


def test_crc_of_known_strings():
    assert M.crc8(b"123456789") == 0xF4 and M.crc16_of([b"123456789", b"", b"\x00123456789"]).tolist() == [0xFEE8, 0, 0xFEE8]


@pytest.mark.parametrize("seed", range(4))
def test_round_trip(seed):
    rng = random.Random(seed)
    texts = [b"a" * 64, bytes(64), bytes(range(256)) * 9, rng.randbytes(64 * 40), b"the cat sat " * 400 + bytes(64), b"\x00\xff" * 2048, *(bytes(rng.choices(b"etaoin shrdlu.\n", k=64 * n)) for n in range(1, 40))]
    streams = M.encode_streams(texts)
    for text, audio in zip(texts, M.decode_streams(streams), strict=True):
        assert (audio.samples[:, 0] + 128).astype(np.uint8).tobytes() == text
        assert audio.blocks == [(a, min(1024, len(text) - a)) for a in range(0, len(text), 1024)]
    for stream in streams:  # the bit-by-bit decoder reads the same frames
        info, _, first = M._stream_info(stream)
        bare = b"fLaC\x80" + stream[5:42] + stream[first:]
        assert (M.decode_streams([bare])[0].samples == M.decode_streams([stream])[0].samples).all()
    assert len(streams[4]) < len(texts[4])


def test_every_kind_of_subframe_is_written():
    rng = np.random.default_rng(1)
    wave = (100 * np.sin(np.arange(1024) / 9)).astype(np.int64) + 128
    walk = np.clip(np.cumsum(rng.integers(-2, 3, 1024)) + 128, 0, 255)
    near = np.clip(rng.integers(-4, 5, 1024) + 128, 0, 255)
    noise = rng.integers(0, 256, 1024)
    kinds = [s[s.index(b"\xff\xf8") :][6] for s in M.encode_streams([bytes(v.astype(np.uint8).tolist()) for v in (wave, walk, near, noise, np.full(1024, 7))])]
    assert kinds == [0x42, 0x12, 0x10, 0x02, 0x00]


def test_partitions_escapes_and_wasted_bits():
    e = [5, -3, 900, 0, -1, 2, 7, -8]

    def subframe(w):
        w.put(0b0_001000_1, 8)
        w.put(0b01, 2)  # two wasted bits
        w.put(1, 2)  # five-bit parameters
        w.put(2, 4)  # four partitions
        for p in range(4):
            if p == 1:
                w.put(31, 5)
                w.put(3, 5)
                for v in e[2 * p : 2 * p + 2]:
                    w.put(v & 7, 3)
            else:
                w.put(p, 5)
                for v in e[2 * p : 2 * p + 2]:
                    rice(w, v, p)

    e[2], e[3] = -4, 3
    stream, pcm = by_hand(1, [[v * 4 for v in e]], subframe, 16, 0, 8)
    assert M.decode_streams([stream])[0].pcm() == pcm


@pytest.mark.parametrize("assignment", [1, 8, 9, 10])
def test_stereo(assignment):
    rng = np.random.default_rng(assignment)
    left, right = rng.integers(-30000, 30000, (2, 32)).tolist()
    side = [a - b for a, b in zip(left, right, strict=True)]
    first, second = {1: (left, right), 8: (left, side), 9: (side, right), 10: ([(a + b) >> 1 for a, b in zip(left, right, strict=True)], side)}[assignment]

    def subframe(w):
        for values, width in ((first, 17 if assignment == 9 else 16), (second, 17 if assignment in (8, 10) else 16)):
            w.put(2, 8)
            for v in values:
                w.put(v & ((1 << width) - 1), width)

    stream, pcm = by_hand(2, [left, right], subframe, 16, assignment, 32)
    assert M.decode_streams([stream])[0].pcm() == pcm


def test_long_predictors():
    x = [3, 8, 20, 41, 60, 90, 100, 95, 70, 33]
    weights, shift = [5, -3, 1], 1

    def subframe(w):
        w.put((31 + 3) << 1, 8)
        for v in x[:3]:
            w.put(v, 8)
        w.put(4, 4)
        w.put(shift, 5)
        for c in weights:
            w.put(c & 31, 5)
        w.put(0, 6)
        w.put(6, 4)
        for i in range(3, len(x)):
            rice(w, x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(weights)) >> shift), 6)

    stream, pcm = by_hand(1, [x], subframe, 8, 0, 10)
    assert M.decode_streams([stream])[0].pcm() == pcm


def test_damage_is_found():
    stream = M.encode_streams([b"some text that is long enough to be packed in a frame of it. " * 30 + bytes(26)])[0]
    for at in range(60, len(stream), 37):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        with pytest.raises(ValueError, match="FLAC"):
            M.decode_streams([bytes(bad)])


def want(text):
    raw = (text or "").encode()
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_awkward_rows(spark):
    found = M.media_round_trip(cases.documents(spark)).collect()
    assert Counter((r[0], *tuple(r)[1:5]) for r in found) == Counter((r[0], *want(r[1])) for r in cases.rows())
    same = {r["doc_id"]: tuple(r)[1:] for r in found}
    assert same[63] == same[64] and same[60] == same[61] and same[4] == same[65]


def test_whole_table_and_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: tuple(r)[1:5] for r in M.media_round_trip(docs).collect()} == {d: want(t) for d, t in texts.items()}
    for r in M.pcm_blocks(M.text_media(docs)).collect():
        assert (np.frombuffer(r["pcm"], np.int8) + np.int16(128)).astype(np.uint8).tobytes() == M.padded(texts[r["doc_id"]])[r["sample_offset"] : r["sample_offset"] + r["samples"]]


def test_empty_table(spark):
    assert M.media_round_trip(cases.documents(spark).where(F.lit(False))).collect() == []
