"""Media columns: bytes as lossless FLAC, and FLAC read back as PCM blocks.

Encoder: mono 8-bit streams in blocks of 1024 samples; each block takes the
cheapest of a constant, verbatim samples, fixed predictors of order 0 or 1 and
a quantised linear predictor of order 2, the residuals in Rice codes. A seek
table lists every frame. Decoder: any mono or stereo stream of up to 24 bits;
frames that use what the encoder writes are decoded side by side, a sample of
every frame at a time, others bit by bit. Frame checksums and the stream's MD5
are verified; damaged media fail the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored, whole

BLOCK, RATE = 1024, 8000
_SHIFT, _PRECISION = 6, 8
#: The encoder picks a Rice parameter that keeps unary parts this short; the side-by-side decoder takes up to 31.
_UNARY = 24
_BATCH_BYTES = 4 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = ((table << 1) ^ np.where(table >> (bits - 1) & 1, poly, 0)) & ((1 << bits) - 1)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def crc8(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc = _CRC8_LIST[crc ^ byte]
    return crc


def crc16_of(parts: list[bytes]) -> np.ndarray:
    """The CRC-16 of each byte string, all at once: leading zeros leave it as it is, so shorter ones are filled up in front."""
    if not parts:
        return np.zeros(0, np.int64)
    width = max(map(len, parts))
    table = np.zeros((width, len(parts)), np.uint8)
    for i, part in enumerate(parts):
        table[width - len(part) :, i] = np.frombuffer(part, np.uint8)
    crc, lookup = np.zeros(len(parts), np.uint16), _CRC16.astype(np.uint16)
    for row in table:
        crc = (crc << 8) ^ lookup[(crc >> 8) ^ row]
    return crc.astype(np.int64)


def _coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | n, *reversed(tail)])


def _frame_header(number: int, size: int) -> bytes:
    code, extra = (0b1010, b"") if size == BLOCK else (0b0111, struct.pack(">H", size - 1))
    head = bytes([0xFF, 0xF8, code << 4 | 0b0100, 0b0010]) + _coded_number(number) + extra
    return head + bytes([crc8(head)])


def _packed(fields: list[tuple[np.ndarray, int]], codes: np.ndarray, k: int) -> list[bytes]:
    """Subframes from header fields (a value a frame, and its width) and Rice codes with parameter ``k``."""
    frames = len(fields[0][0])
    quotient, low = codes >> k, codes & ((1 << k) - 1)
    lengths = quotient + (1 + k)
    header = sum(w for _, w in fields)
    sizes = (header + lengths.sum(axis=1) + 7) // 8
    base = np.concatenate(([0], np.cumsum(sizes)))
    bits = np.zeros(int(base[-1]) * 8, np.uint8)
    at = base[:-1] * 8
    for value, width in fields:
        for j in range(width):
            bits[at + j] = (value >> (width - 1 - j)) & 1
        at = at + width
    stop = (at[:, None] + np.cumsum(lengths, axis=1) - lengths + quotient).ravel()
    bits[stop] = 1
    low = low.ravel()
    for j in range(k):
        bits[stop + (1 + j)] = (low >> (k - 1 - j)) & 1
    raw = np.packbits(bits).tobytes()
    return [raw[base[i] : base[i + 1]] for i in range(frames)]


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 31)


def _rice_cost(codes: np.ndarray, header: int) -> tuple[np.ndarray, np.ndarray]:
    """Each frame's best Rice parameter, and its bits."""
    mean = codes.mean(axis=1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
    least = np.maximum(np.ceil(np.log2((codes.max(axis=1) + 1) / (_UNARY + 1))), 0).astype(np.int64)
    best, bits = np.maximum(guess, least), None
    for k in (best, best + 1):
        cost = header + codes.shape[1] * (1 + k) + (codes >> k[:, None]).sum(axis=1)
        bits, best = (cost, k) if bits is None else (np.minimum(bits, cost), np.where(cost < bits, k, best))
    return best, bits


def _subframes(x: np.ndarray) -> list[bytes]:
    """The cheapest subframe of each row of samples (all of one length)."""
    n = x.shape[1]
    out: list[bytes] = [b""] * len(x)
    flat = (x == x[:, :1]).all(axis=1)
    r = [np.einsum("ij,ij->i", *(v.astype(float) for v in (x[:, lag:], x[:, : n - lag]))) for lag in range(3)]
    det = np.maximum(r[0] ** 2 - r[1] ** 2, 1e-9)
    a = np.clip(np.rint(np.stack([r[1] * (r[0] - r[2]), r[0] * r[2] - r[1] ** 2]) / det * (1 << _SHIFT)), -127, 127).astype(np.int32)
    predicted = (a[0][:, None] * x[:, 1:-1] + a[1][:, None] * x[:, :-2]) >> _SHIFT
    ways = [_zigzag(x), _zigzag(x[:, 1:] - x[:, :-1]), _zigzag(x[:, 2:] - predicted)]
    headers = [8 + 10, 8 + 8 + 10, 8 + 16 + 9 + 2 * _PRECISION + 10]
    ks, costs = zip(*(_rice_cost(c, h) for c, h in zip(ways, headers, strict=True)), strict=True)
    choice = np.argmin(np.stack([*costs, np.full(len(x), 8 + 8 * n)]), axis=0)
    for i in np.flatnonzero(flat):
        out[i] = bytes([0, int(x[i, 0]) & 0xFF])
    for i in np.flatnonzero(~flat & (choice == 3)):
        out[i] = b"\x02" + x[i].astype(np.int8).tobytes()
    for way, codes in enumerate(ways):
        for k in range(16):
            rows = np.flatnonzero(~flat & (choice == way) & (ks[way] == k))
            if not len(rows):
                continue
            full = lambda v: np.full(len(rows), v)  # noqa: B023, E731
            kind = (0b001000 | way) if way < 2 else 0b100001
            fields = [(full(kind << 1), 8), *((x[rows, j] & 0xFF, 8) for j in range(way))]
            if way == 2:
                fields += [(full(_PRECISION - 1), 4), (full(_SHIFT), 5), *((c[rows] & 0xFF, _PRECISION) for c in a)]
            fields += [(full(0), 6), (full(k), 4)]
            for i, raw in zip(rows, _packed(fields, codes[rows].astype(np.int64), k), strict=True):
                out[i] = raw
    return out


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload: its bytes less 128 as 8-bit samples."""
    frames: list[tuple[int, int, bytes]] = []
    for s, payload in enumerate(payloads):
        frames += [(s, at, payload[at : at + BLOCK]) for at in range(0, len(payload), BLOCK)]
    subframes: list[bytes] = [b""] * len(frames)
    for n in {len(f[2]) for f in frames}:
        rows = [i for i, f in enumerate(frames) if len(f[2]) == n]
        x = np.frombuffer(b"".join(frames[i][2] for i in rows), np.uint8).reshape(-1, n).astype(np.int32) - 128
        short = [b"\x02" + r.astype(np.int8).tobytes() for r in x] if n < 3 else _subframes(x)
        for i, raw in zip(rows, short, strict=True):
            subframes[i] = raw
    bodies = [_frame_header(at // BLOCK, len(block)) + sub for (_, at, block), sub in zip(frames, subframes, strict=True)]
    checks = crc16_of(bodies).tolist()
    data: list[list[bytes]] = [[] for _ in payloads]
    points: list[list[bytes]] = [[] for _ in payloads]
    sizes = [0] * len(payloads)
    for (s, at, block), body, check in zip(frames, bodies, checks, strict=True):
        points[s].append(struct.pack(">QQH", at, sizes[s], len(block)))
        data[s] += [body, struct.pack(">H", check)]
        sizes[s] += len(body) + 2
    out = []
    for payload, parts, seek in zip(payloads, data, points, strict=True):
        samples = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        lengths = [len(a) + 2 for a in parts[::2]]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lengths, default=0).to_bytes(3, "big") + max(lengths, default=0).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(samples).digest()
        table = b"".join(seek)
        if len(table) >= 1 << 24:  # a longer table than a metadata block holds: every so many frames
            step = -(-len(table) // ((1 << 24) - 18))
            table = b"".join(seek[::step])
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(parts))
    return out


class _Bits:
    """Reads a byte string from its most significant bits on."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise ValueError("FLAC: the stream ends inside a frame")
        word = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return word & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


#: Fixed values of the format: block sizes, sample sizes and predictors by their codes.
_SIZES = {1: 192, **{2 + i: 576 << i for i in range(4)}, **{8 + i: 256 << i for i in range(8)}}
_SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


@dataclass
class _Frame:
    first: int  # sample number
    size: int
    channels: int
    bits: int
    body: int  # byte at which its subframes begin


@dataclass
class Audio:
    rate: int
    channels: int
    bits: int
    blocks: list[tuple[int, int]]  # sample offset and samples of each block
    samples: np.ndarray  # by sample and channel

    def pcm(self) -> bytes:
        """Signed little-endian samples, channels interleaved."""
        width = (self.bits + 7) // 8
        return np.ascontiguousarray(self.samples, "<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _read_header(data: bytes, at: int, info: dict) -> _Frame:
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("FLAC: no frame where one should begin")
    code, channels, bits = data[at + 2] >> 4, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    lead = data[at + 4]
    size = 1 if lead < 0x80 else next((s for s in range(2, 8) if (lead << s & 0xFF) < 0x80 or s == 7), 7)
    number = lead if size == 1 else lead & (0x7F >> size)
    for byte in data[at + 5 : at + 4 + size]:
        number = number << 6 | byte & 0x3F
    end = at + 4 + size
    if code in (6, 7):
        block = int.from_bytes(data[end : end + code - 5], "big") + 1
        end += code - 5
    else:
        block = _SIZES.get(code, 0)
    rate = data[at + 2] & 15
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not block or channels > 10 or end >= len(data) or crc8(data[at:end]) != data[end]:
        raise ValueError("FLAC: a frame header's checksum is wrong")
    first = number if data[at + 1] & 1 else number * info["block"]
    return _Frame(first, block, channels, _SAMPLE_BITS.get(bits, info["bits"]), end + 1)


def _subframe(bits: _Bits, n: int, width: int) -> list[int]:
    """One channel of a frame, bit by bit, with every feature of the format."""
    if bits.take(1):
        raise ValueError("FLAC: a subframe's padding bit is set")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        out = [bits.signed(width)] * n
    elif kind == 1:
        out = [bits.signed(width) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(width) for _ in range(order)]
        if kind < 32:
            weights, shift = _FIXED[order], 0
        else:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        wide, parts = bits.take(2), 1 << bits.take(4)
        if wide > 1 or n % parts:
            raise ValueError("FLAC: an unknown residual coding")
        for p in range(parts):
            k = bits.take(4 + wide)
            raw = bits.take(5) if k == (15, 31)[wide] else None
            for _ in range(n // parts - (order if p == 0 else 0)):
                if raw is None:
                    u = bits.unary() << k | bits.take(k)
                    e = u >> 1 ^ -(u & 1)
                else:
                    e = bits.signed(raw)
                out.append(e + (sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift if shift >= 0 else 0))
    else:
        raise ValueError("FLAC: an unknown subframe")
    return [v << wasted for v in out]


def _slow_frame(data: bytes, frame: _Frame) -> tuple[np.ndarray, int]:
    """A frame's samples by channel, and the byte after its subframes."""
    bits = _Bits(data, frame.body)
    side = {8: 1, 9: 0, 10: 1}.get(frame.channels)
    count = 2 if side is not None else frame.channels + 1
    x = np.array([_subframe(bits, frame.size, frame.bits + (c == side)) for c in range(count)], np.int64)
    if frame.channels == 8:
        x[1] = x[0] - x[1]
    elif frame.channels == 9:
        x[0] = x[1] + x[0]
    elif frame.channels == 10:
        mid = x[0] << 1 | x[1] & 1
        x = np.stack([(mid + x[1]) >> 1, (mid - x[1]) >> 1])
    return x, (bits.at + 7) >> 3


def _fast_frames(data: bytes, frames: list[_Frame]) -> list[tuple[np.ndarray, int] | None]:
    """Mono 8-bit frames side by side; None for a frame that needs the slow way."""
    out: list[tuple[np.ndarray, int] | None] = [None] * len(frames)
    rows = []
    for i, f in enumerate(frames):
        kind = data[f.body] if f.channels == 0 and f.bits == 8 else 0xFF
        if kind == 0:
            out[i] = np.full((1, f.size), np.int8(data[f.body + 1] - 256 * (data[f.body + 1] > 127)), np.int64), f.body + 2
        elif kind == 2:
            out[i] = np.frombuffer(data, np.int8, f.size, f.body + 1).astype(np.int64)[None], f.body + 1 + f.size
        elif kind in (0x10, 0x12, 0x14, 0x40, 0x42):
            order = (kind >> 1) - 8 if kind < 0x40 else (kind >> 1) - 31
            bits = _Bits(data, f.body + 1)
            warm = [bits.signed(8) for _ in range(order)]
            weights, shift = _FIXED[order], 0
            if kind >= 0x40:
                precision, shift = bits.take(4) + 1, bits.signed(5)
                weights = [bits.signed(precision) for _ in range(order)]
            k = bits.take(10)  # coding 0, one partition, and the parameter
            if k < 15 and shift >= 0:
                rows.append((f.size, i, order, bits.at, k, shift, (*weights, 0, 0)[:2], (*warm, 0, 0)[:2]))
    if not rows:
        return out
    rows.sort(key=lambda r: -r[0])
    size, order, at, k, shift = (np.array([r[j] for r in rows], np.int64) for j in (0, 2, 3, 4, 5))
    weights, warm = (np.array([r[j] for r in rows], np.int64) for j in (6, 7))
    words = np.ndarray((len(data) + 1,), ">u8", data + bytes(16), 0, (1,))
    x = np.zeros((int(size[0]), len(rows)), np.int64)
    failed = np.zeros(len(rows), bool)
    active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    back1, back2 = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    one, limit = np.uint64(1), len(data)
    for i in range(int(size[0])):
        n = int(active[i])
        pos, q_k = at[:n], k[:n]
        word = words[np.minimum(pos >> 3, limit)].astype(np.uint64) << (pos & 7).astype(np.uint64)
        top = word >> np.uint64(32)
        quotient = 1054 - ((top | one).astype(np.float64).view(np.int64) >> 52)
        bad = top == 0
        low = (((word << quotient.astype(np.uint64)) << one) >> one) >> (63 - q_k).astype(np.uint64)
        u = quotient << q_k | low.astype(np.int64)
        value = (u >> 1 ^ -(u & 1)) + ((weights[:n, 0] * back1[:n] + weights[:n, 1] * back2[:n]) >> shift[:n])
        used = quotient + 1 + q_k
        if i < 2:
            head = i < order[:n]
            value, used, bad = np.where(head, warm[:n, i], value), np.where(head, 0, used), bad & ~head
        if bad.any():
            failed[:n] |= bad
        x[i, :n] = value
        back2[:n] = back1[:n]
        back1[:n] = value
        at[:n] += used
    for j, r in enumerate(rows):
        if not failed[j] and at[j] <= 8 * limit:
            out[r[1]] = x[: r[0], j][None], int(at[j] + 7) >> 3
    return out


def _stream_info(data: bytes) -> tuple[dict, list[tuple[int, int]], int]:
    """Stream parameters, seek points (sample, offset), and where frames begin."""
    if data[:4] != b"fLaC":
        raise ValueError("FLAC: not a stream")
    at, info, seek, last = 4, {}, [], False
    while not last:
        if at + 4 > len(data):
            raise ValueError("FLAC: the stream ends inside its metadata")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "total": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            seek = [(s, o) for s, o, _ in struct.iter_unpack(">QQH", body) if s < (1 << 64) - 1]
        at += 4 + size
    if not info:
        raise ValueError("FLAC: no stream information")
    return info, seek, at


def decode_streams(streams: list[bytes]) -> list[Audio]:
    """The audio of each stream, checked against all its checksums."""
    infos = [_stream_info(s) for s in streams]
    data = b"".join(streams)
    base = np.concatenate(([0], np.cumsum([len(s) for s in streams]))).tolist()
    found: list[list[tuple[_Frame, np.ndarray]]] = [[] for _ in streams]
    frames, owner, starts, ends = [], [], [], []
    for s, (info, seek, first) in enumerate(infos):
        if [p for p, _ in seek] == list(range(0, info["total"], info["block"] or 1)) and seek:  # every frame is listed
            places = [base[s] + first + o for _, o in seek]
            for at, end in zip(places, [*places[1:], base[s + 1]], strict=True):
                frames.append(_read_header(data, at, info))
                owner.append(s)
                starts.append(at)
                ends.append(end)
    checked: list[tuple[bytes, int]] = []
    for f, s, at, end, quick in zip(frames, owner, starts, ends, _fast_frames(data, frames), strict=True):
        x, stop = quick or _slow_frame(data, f)
        if stop + 2 != end:
            raise ValueError("FLAC: a frame does not end where the next begins")
        checked.append((data[at:stop], int.from_bytes(data[stop:end], "big")))
        found[s].append((f, x))
    for s, (info, _, first) in enumerate(infos):
        at = base[s] + first
        while not found[s] and info["total"] or at > base[s] + first and at < base[s + 1]:  # no such list: frame after frame
            f = _read_header(data, at, info)
            x, stop = _slow_frame(data[: base[s + 1]], f)
            checked.append((data[at:stop], int.from_bytes(data[stop : stop + 2], "big")))
            found[s].append((f, x))
            at = stop + 2
    if (crc16_of([part for part, _ in checked]) != np.array([c for _, c in checked], np.int64)).any():
        raise ValueError("FLAC: a frame's checksum is wrong")
    out = []
    for (info, _, _), parts in zip(infos, found, strict=True):
        samples = np.concatenate([x for _, x in parts], axis=1).T if parts else np.zeros((0, info["channels"]), np.int64)
        audio = Audio(info["rate"], info["channels"], info["bits"], [(f.first, f.size) for f, _ in parts], samples)
        if len(samples) != info["total"] or any(info["md5"]) and hashlib.md5(audio.pcm()).digest() != info["md5"]:
            raise ValueError("FLAC: the samples are not those that were stored")
        out.append(audio)
    return out


def padded(text: str | None) -> bytes:
    """The text in UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(max(64, -len(raw) % 64 + len(raw)) - len(raw))


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, list]]:
    """Runs of a batch's values that together hold about ``most`` bytes."""
    values = batch.column(column).to_pylist()
    at = size = 0
    for i, v in enumerate(values):
        size += len(v or "")
        if size >= most:
            yield at, values[at : i + 1]
            at, size = i + 1, 0
    if at < len(values):
        yield at, values[at:]


#: How the streams are written: Parquet packs what a frame leaves of the text's redundancy.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text stored as a FLAC stream (null and empty: 64 bytes of 0)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch, "text", _BATCH_BYTES):
                media = encode_streams([padded(t) for t in texts])
                sizes = [len(t.encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(texts)), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(encoded, f"doc_id {kind}, n_bytes long, media binary")


def _feature(x: np.ndarray) -> str:
    """Level, root mean square, zero crossings about the mean and mean step of the samples."""
    v = x.astype(np.float64)
    mean = float(v.mean())
    above = v >= mean
    crossings, step = (int((above[1:] != above[:-1]).sum()), float(np.abs(np.diff(v)).mean())) if len(v) > 1 else (0, 0.0)
    return f"mean={mean:.4f};rms={np.sqrt(np.mean(v * v)):.4f};crossings={crossings};step={step:.4f}"


def media_features(media: DataFrame) -> DataFrame:
    """Per row of (doc_id, n_bytes, media), what the decoded bytes and the stored form are."""
    kind = media.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, streams in _slices(batch, "media", _BATCH_BYTES):
                rows = []
                for stream, audio in zip(streams, decode_streams(streams), strict=True):
                    payload = (audio.samples[:, 0] + 128).astype(np.uint8).tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), _feature(audio.samples[:, 0])))
                names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
                columns = {n: pa.array(v) for n, v in zip(names, zip(*rows, strict=True), strict=True)}
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(at, len(streams)) for c in ("doc_id", "n_bytes")} | columns)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, out)


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, block, sample_offset, samples, channels, bits, rate, pcm: the decoded blocks of every stream; null media give none.

    A reader seeks to a sample by its offset without decoding what lies before.
    """
    kind = media.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, streams in _slices(batch, column, _BATCH_BYTES):
                rows = []
                for k, audio in zip(batch.column(key).slice(at, len(streams)).to_pylist(), decode_streams(streams), strict=True):
                    raw, width = audio.pcm(), (audio.bits + 7) // 8 * audio.channels
                    rows += [(k, b, o, n, audio.channels, audio.bits, audio.rate, raw[o * width : (o + n) * width]) for b, (o, n) in enumerate(audio.blocks)]
                types = [batch.schema.field(key).type, *[pa.int64()] * 3, *[pa.int32()] * 3, pa.binary()]
                names = [key, "block", "sample_offset", "samples", "channels", "bits", "rate", "pcm"]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)

    return media.select(key, column).where(F.col(column).isNotNull()).mapInArrow(read, f"{key} {kind}, block long, sample_offset long, samples long, channels int, bits int, rate int, pcm binary")


def media_round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document.

    Every whole text's stored form is written to the shared folder and what
    is read back from there is decoded.
    Equal texts give equal values; repeated rows give repeated rows; null is
    as empty; an empty table gives no rows.
    """
    return media_features(stored(text_media(docs.select("doc_id", "text")), "media", **STORED))
