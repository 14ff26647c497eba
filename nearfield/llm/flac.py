"""FLAC streams of 8-bit mono samples (op8): frames of Rice-coded residuals, written and read side by side.

A stream has STREAMINFO (with the MD5 of its samples), a SEEKTABLE with a point for every frame, and frames of 1024
samples, of which the last may be shorter. Each frame takes the fixed predictor of order 0 to 2, or the linear predictor of
order 2 with quantised coefficients, that promises the fewest bits; residuals are Rice-coded with one parameter. Frame
headers end with a CRC-8 and frames with a CRC-16, and reading checks both and the MD5. Reading takes frames from the seek table, and
walks many frames at once, one residual a step. Streams of other writers, with constant or verbatim subframes, several Rice
partitions, higher orders or no seek table, are read bit by bit.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.cluster import ship
from nearfield.llm.wordscan import text_chunks

FRAME = 1024
PAD = 64
RATE = 8000
PRECISION, SHIFT = 8, 5
MAX_RICE = 14
CHUNK = 1 << 19
#: Frames that are written or read side by side; a frame takes about 180 times its samples in memory meanwhile
RUN = 512


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, np.int64)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc_many(data: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each byte range, all ranges side by side."""
    order = np.argsort(-size, kind="stable")
    start, left = start[order], size[order]
    crc = np.zeros(len(start), np.int64)
    stops = len(size) - np.searchsorted(left[::-1], np.arange(1, int(left[0]) + 1)) if len(left) else []
    for step, n in enumerate(stops):
        byte = data[start[:n] + step]
        crc[:n] = CRC8[crc[:n] ^ byte] if bits == 8 else CRC16[crc[:n] >> 8 ^ byte] ^ (crc[:n] << 8 & 0xFFFF)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size) of frame numbers, coded as UTF-8 would up to 36 bits; rows of seven bytes."""
    size = 1 + np.searchsorted([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31], k, "right")
    out = np.zeros((len(k), 7), np.uint8)
    out[size == 1, 0] = k[size == 1]
    for n in range(2, 8):
        own = np.flatnonzero(size == n)
        for j in range(1, n):
            out[own, j] = 0x80 | k[own] >> 6 * (n - 1 - j) & 0x3F
        out[own, 0] = (0xFF00 >> n & 0xFF) | (k[own] >> 6 * (n - 1) if n < 7 else 0)
    return out, size


def _lpc(x: np.ndarray, frame: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised order-2 coefficients of each frame from its autocorrelation."""
    product = lambda lag: np.add.reduceat(np.append(np.where(frame[lag:] == frame[: len(x) - lag], x[lag:] * x[: len(x) - lag], 0), np.zeros(lag, np.int64)), begin)
    r0, r1, r2 = (product(k).astype(np.float64) for k in range(3))
    det = r0 * r0 - r1 * r1
    safe = np.where(det <= 0, 1.0, det)
    a, b = np.where(det > 0, (r1 * r0 - r1 * r2) / safe, 0), np.where(det > 0, (r0 * r2 - r1 * r1) / safe, 0)
    limit = (1 << (PRECISION - 1)) - 1
    return tuple(np.clip(np.round(v * (1 << SHIFT)), -limit, limit).astype(np.int64) for v in (a, b))


class _Frames:
    """The frames of the payloads in a run of bytes; the first payload goes on from frame `at` of its stream."""

    def __init__(self, offs: np.ndarray, at: int = 0):
        sizes = np.diff(offs)
        self.per_row = -(-sizes // FRAME)
        self.row = np.repeat(np.arange(len(sizes)), self.per_row)
        self.first = np.concatenate([[0], np.cumsum(self.per_row)])
        self.number = np.arange(len(self.row)) - self.first[self.row]
        self.begin = offs[self.row] + self.number * FRAME
        self.size = np.minimum(FRAME, offs[self.row + 1] - self.begin)
        self.number = self.number + np.where(self.row == 0, at, 0)


def encode(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """A stream for each payload; payloads are of one byte or more. A payload of more than RUN frames is written run by run."""
    if len(offs) == 2 and len(data) > RUN * FRAME:
        parts = []
        for k in range(0, len(data), RUN * FRAME):
            own = data[k : k + RUN * FRAME]
            parts.append(_frames(own, np.array([0, len(own)]), k // FRAME))
        return [_stream((data ^ 0x80).tobytes(), b"".join(raw for raw, _, _ in parts), np.concatenate([size for _, size, _ in parts]))]
    raw, size, first = _frames(data, offs)
    streams, samples, at = [], (data ^ 0x80).tobytes(), 0
    for r in range(len(offs) - 1):
        own = size[first[r] : first[r + 1]]
        total = int(own.sum())
        streams.append(_stream(samples[offs[r] : offs[r + 1]], raw[at : at + total], own))
        at += total
    return streams


def _stream(samples: bytes, frames: bytes, size: np.ndarray) -> bytes:
    """The stream of samples (as unsigned bytes), given its frames and their sizes."""
    n, points = len(samples), np.zeros(len(size), [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
    points["sample"], points["offset"] = np.arange(len(size)) * FRAME, np.cumsum(size) - size
    points["size"] = np.minimum(FRAME, n - points["sample"].astype(np.int64))
    block = min(FRAME, n) if len(size) == 1 else FRAME
    info = max(16, block).to_bytes(2, "big") * 2 + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(samples).digest()
    table = points.tobytes()
    return b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table + frames


def _frames(data: np.ndarray, offs: np.ndarray, at: int = 0) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(frames, their sizes, where each payload's begin) of payloads, of which the first goes on from frame `at`."""
    f = _Frames(offs, at)
    n, count = len(data), len(f.row)
    x = data.astype(np.int64) - 128
    frame = np.repeat(np.arange(count), f.size)
    pos = np.arange(n) - f.begin[frame]
    back = [x, *(np.concatenate([np.zeros(k, np.int64), x[:-k]])[:n] for k in (1, 2))]
    a, b = _lpc(x, frame, f.begin, f.size)
    trials = [x, x - back[1], x - 2 * back[1] + back[2], x - ((a[frame] * back[1] + b[frame] * back[2]) >> SHIFT)]
    orders = np.array([0, 1, 2, 2])
    cost, codes = np.empty((4, count), np.int64), []
    for k, residual in enumerate(trials):
        u = residual << 1 ^ residual >> 63
        codes.append(np.where(pos < orders[k], 0, u))
        cost[k] = np.add.reduceat(codes[k], f.begin)
    cost[3] += 3 * f.size // 4 + 25  # coefficients must earn their bits
    cost[:, f.size < 4] += np.array([[0], [1 << 40], [1 << 40], [1 << 40]])
    kind = cost.argmin(axis=0)
    order = orders[kind]
    u = np.choose(kind[frame], codes)
    coded = pos >= order[frame]
    mean = np.add.reduceat(u, f.begin) / np.maximum(f.size - order, 1)
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))), 0, MAX_RICE).astype(np.int64)
    k_of = rice[frame]
    q = u >> k_of
    length = np.where(coded, q + 1 + k_of, 0)
    ends = np.cumsum(length)
    place = ends - length
    place -= place[f.begin][frame]
    total = np.add.reduceat(length, f.begin)
    lpc = kind == 3
    lead = 8 + 8 * order + np.where(lpc, 9 + 2 * PRECISION, 0) + 10
    body = (lead + total + 7) >> 3
    number, digits = _utf8_number(f.number)
    head = 4 + digits + 2 + 1
    size = head + body + 2
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start], out[start + 1], out[start + 2], out[start + 3] = 0xFF, 0xF8, 0x70, 0x02
    for j in range(7):
        own = digits > j
        out[(start + 4 + j)[own]] = number[own, j]
    out[start + 4 + digits], out[start + 5 + digits] = (f.size - 1) >> 8, (f.size - 1) & 0xFF
    out[start + head - 1] = crc_many(out, start, head - 1, 8)

    bits = np.zeros(8 * len(out), np.uint8)
    origin = 8 * (start + head)

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[where + j] = value >> (width - 1 - j) & 1

    put(origin, np.where(lpc, 0b100001, 0b001000 + order) << 1, 8)
    for j in range(2):
        own = order > j
        put(origin[own] + 8 + 8 * j, x[f.begin[own] + j] & 0xFF, 8)
    own = np.flatnonzero(lpc)
    at_lpc = origin[own] + 24
    put(at_lpc, np.full(len(own), PRECISION - 1), 4)
    put(at_lpc + 4, np.full(len(own), SHIFT), 5)
    put(at_lpc + 9, a[own] & 0xFF, PRECISION)
    put(at_lpc + 9 + PRECISION, b[own] & 0xFF, PRECISION)
    put(origin + lead - 4, rice, 4)
    place = (origin + lead)[frame][coded] + place[coded] + q[coded]
    bits[place] = 1
    u, k_of = u[coded], k_of[coded]
    for j in range(int(rice.max(initial=0))):
        own = k_of > j
        bits[place[own] + k_of[own] - j] = u[own] >> j & 1
    out |= np.packbits(bits)
    crc = crc_many(out, start, size - 2, 16)
    out[start + size - 2], out[start + size - 1] = crc >> 8, crc & 0xFF

    return out.tobytes(), size, f.first


class Unread(ValueError):
    """A valid form that the readers of many frames at once don't know."""


class Stream:
    """The headers of a stream: number of samples, MD5, seek points, and where frames begin."""

    def __init__(self, stream: bytes):
        if stream[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, np.zeros(0, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        while not last:
            last, kind, size = stream[at] >= 128, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
            at += 4
            if kind == 0:
                told = int.from_bytes(stream[at + 10 : at + 18], "big")
                self.samples, self.md5 = told & (1 << 36) - 1, stream[at + 18 : at + 34]
                if told >> 36 & 0xFF != 7:
                    raise ValueError("only 8-bit mono streams are read")
            elif kind == 3:
                self.points = np.frombuffer(stream, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")], size // 18, at)
            at += size
        self.frames = at


def decode_frames(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples as bytes, number of them in each) of frames at byte ranges of data that follow each other, all checked by their CRCs."""
    found = [(np.zeros(0, np.uint8), np.zeros(0, np.int64))]
    for k in range(0, len(start), RUN):
        lo, hi = int(start[k]), int(stop[k : k + RUN].max())
        found.append(_decode_run(data[lo:hi], start[k : k + RUN] - lo, stop[k : k + RUN] - lo))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _decode_run(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.append(data, np.zeros(8, np.uint8))
    wide = data.astype(np.int64)
    if ((wide[start] != 0xFF) | (wide[start + 1] != 0xF8) | (wide[start + 2] != 0x70) | (wide[start + 3] != 0x02)).any():
        raise Unread("a frame has no header of the kind that is read here")
    lead = wide[start + 4]
    digits = np.where(lead < 0x80, 1, 8 - np.ceil(np.log2(256 - lead + 0.0)).astype(np.int64))
    size = (wide[start + 4 + digits] << 8 | wide[start + 5 + digits]) + 1
    head = 7 + digits
    if (crc_many(data, start, head - 1, 8) != wide[start + head - 1]).any():
        raise ValueError("a frame header fails its CRC-8")
    if (crc_many(data, start, stop - start - 2, 16) != (wide[stop - 2] << 8 | wide[stop - 1])).any():
        raise ValueError("a frame fails its CRC-16")
    w24 = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    take = lambda at, width: w24[at >> 3] >> (24 - (at & 7) - width) & (1 << width) - 1
    origin = 8 * (start + head)
    kind = take(origin, 8) >> 1
    lpc = kind >= 0b100000
    order = np.where(lpc, kind - 0b100000 + 1, kind - 0b001000)
    if ((order < 0) | (order > 4)).any():
        raise Unread("a subframe is of a kind that is not read here")
    most, count = int(size.max(initial=0)), len(start)
    ranked = np.argsort(-size, kind="stable")
    inverse = np.empty_like(ranked)
    inverse[ranked] = np.arange(count)
    origin, order, lpc, length = origin[ranked], order[ranked], lpc[ranked], size[ranked]
    out = np.zeros((most, count), np.int32)
    signed = lambda v, width: v - (v >> (width - 1) << width)
    for j in range(int(order.max(initial=0))):
        own = np.flatnonzero(order > j)
        out[j, own] = signed(take(origin[own] + 8 + 8 * j, 8), 8)
    at = origin + 8 + 8 * order
    shift, weights = np.zeros(count, np.int64), np.zeros((4, count), np.int64)
    own = np.flatnonzero(lpc)
    width = take(at[own], 4) + 1
    shift[own] = take(at[own] + 4, 5)
    for j in range(int(order[own].max(initial=0))):
        some = order[own] > j
        weights[j, own[some]] = signed(take((at[own] + 9 + j * width)[some], width[some]), width[some])
    at[own] += 9 + order[own] * width
    rice = take(at + 6, 4)
    if ((take(at, 6) != 0) | (rice == 15)).any():
        raise Unread("residuals are coded in a way that is not read here")
    at += 10
    bits = np.unpackbits(data)
    ones = np.append(np.flatnonzero(bits), len(bits))
    before = np.cumsum(bits, dtype=np.int32) - bits
    mask = (1 << rice) - 1
    active = count - np.searchsorted(length[::-1], np.arange(1, most + 1))
    waiting = int(order.max(initial=0))
    for t in range(most):
        n = int(active[t])
        p = at[:n]
        one = ones[before[p]]
        low = one + 1
        k = rice[:n]
        u = one - p << k | w24[low >> 3] >> (24 - (low & 7) - k) & mask[:n]
        r = u >> 1 ^ -(u & 1)
        if t < waiting:
            some = order[:n] <= t
            out[t, :n][some] = r[some]
            at[:n][some] = (low + k)[some]
        else:
            out[t, :n] = r
            at[:n] = low + k
    for p in range(1, 5):
        own = np.flatnonzero(~lpc & (order == p))
        if len(own):
            out[:, own] = _undo(out[:, own].astype(np.int64), p)
    own = np.flatnonzero(lpc)
    if len(own):
        x, w, s, o = out[:, own].astype(np.int64), weights[:, own], shift[own], order[own]
        for t in range(1, most):
            guess = sum(w[j] * x[t - 1 - j] for j in range(min(4, t)))
            x[t] += np.where(t >= o, guess >> s, 0)
        out[:, own] = x
    samples = (out.T[inverse] + 128).astype(np.uint8)
    return samples[np.arange(most) < size[:, None]], size


def _undo(x: np.ndarray, order: int) -> np.ndarray:
    """Samples of columns that hold `order` first samples and then their order-th differences."""
    heads = [x[:order]]
    for _ in range(order - 1):
        heads.append(np.diff(heads[-1], axis=0))
    y = x[order:]
    for j in range(order - 1, -1, -1):
        last = heads[j][order - 1 - j]  # the last known j-th difference
        y = last + np.cumsum(y, axis=0)
    return np.concatenate([x[:order], y])


class _Bits:
    """Numbers from a run of bits."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, width: int) -> int:
        lo, self.at = self.at, self.at + width
        if self.at > 8 * len(self.data):
            raise ValueError("a frame ends before its time")
        return int.from_bytes(self.data[lo >> 3 : (self.at + 7) >> 3], "big") >> (-self.at & 7) & (1 << width) - 1

    def signed(self, width: int) -> int:
        value = self.take(width) if width else 0
        return value - (value >> (width - 1) << width) if width else 0

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _plain_subframe(bits: _Bits, n: int, width: int) -> list[int]:
    if bits.take(1):
        raise ValueError("a subframe doesn't begin with zero")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = 1 + bits.unary()
    width -= wasted
    if kind == 0:
        x = [bits.signed(width)] * n
    elif kind == 1:
        x = [bits.signed(width) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [bits.signed(width) for _ in range(order)]
        if kind < 32:
            weights, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        else:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        wide, parts = 4 + bits.take(2), 1 << bits.take(4)
        residuals = []
        for k in range(parts):
            rice = bits.take(wide)
            many = n // parts - (order if k == 0 else 0)
            if rice == (1 << wide) - 1:
                raw = bits.take(5)
                residuals += [bits.signed(raw) for _ in range(many)]
            else:
                for _ in range(many):
                    u = bits.unary() << rice | (bits.take(rice) if rice else 0)
                    residuals.append(u >> 1 ^ -(u & 1))
        for r in residuals:
            x.append(r + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("a subframe is of a reserved kind")
    return [v << wasted for v in x]


def decode_plain(stream: bytes) -> bytes:
    """The payload of any 8-bit mono stream, frame by frame and bit by bit, checked by all its CRCs."""
    head, out = Stream(stream), []
    bits, data = _Bits(stream, head.frames), np.frombuffer(stream, np.uint8)
    while bits.at < 8 * len(stream):
        begin = bits.at >> 3
        if bits.take(15) != 0b111111111111100:
            raise ValueError("a frame has no header")
        bits.take(1)
        block, rate, channels, size = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        if channels or size not in (0, 1) or bits.take(1):
            raise ValueError("only 8-bit mono streams are read")
        lead = bits.take(8)
        for _ in range(max(0, 7 - (255 - lead).bit_length()) if lead >= 0x80 else 0):
            bits.take(8)
        n = 192 if block == 1 else 576 << block - 2 if 2 <= block <= 5 else bits.take(8) + 1 if block == 6 else bits.take(16) + 1 if block == 7 else 256 << block - 8
        bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0)) if rate in (12, 13, 14) else None
        at = bits.at >> 3
        if crc_many(data, np.array([begin]), np.array([at - begin]), 8)[0] != bits.take(8):
            raise ValueError("a frame header fails its CRC-8")
        out += _plain_subframe(bits, n, 8)
        bits.at = bits.at + 7 & ~7
        at = bits.at >> 3
        if crc_many(data, np.array([begin]), np.array([at - begin]), 16)[0] != bits.take(16):
            raise ValueError("a frame fails its CRC-16")
    return bytes(v + 128 for v in out)


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, checked by all its CRCs and its MD5."""
    try:
        return _decode_many(streams)
    except Unread:
        if len(streams) > 1:
            return [decode([s])[0] for s in streams]
        return [_checked(decode_plain(streams[0]), Stream(streams[0]))]


def _checked(payload: bytes, head: Stream) -> bytes:
    if any(head.md5) and hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest() != head.md5:
        raise ValueError("a stream fails its MD5")
    return payload


def _decode_many(streams: list[bytes]) -> list[bytes]:
    heads, starts, stops, at = [Stream(s) for s in streams], [], [], 0
    for s, h in zip(streams, heads, strict=True):
        points = h.points["sample"].astype(np.int64)
        if not len(points) or points[0] or (points != np.arange(len(points)) * FRAME).any() or len(points) != -(-h.samples // FRAME):
            raise Unread("the seek table doesn't have all frames")
        begin = at + h.frames + h.points["offset"].astype(np.int64)
        starts.append(begin)
        stops.append(np.append(begin[1:], at + len(s)))
        at += len(s)
    samples, size = decode_frames(np.frombuffer(b"".join(streams), np.uint8), np.concatenate(starts), np.concatenate(stops))
    raw, out, at = samples.tobytes(), [], 0
    for h in heads:
        out.append(_checked(raw[at : at + h.samples], h))
        at += h.samples
    return out


def read_samples(stream: bytes, first: int, count: int) -> bytes:
    """Samples first to first + count of a stream, from the frames that hold them alone."""
    head = Stream(stream)
    begins = head.points["sample"].astype(np.int64)
    lo, hi = int(np.searchsorted(begins, first, "right")) - 1, int(np.searchsorted(begins, first + count))
    starts = head.frames + head.points["offset"].astype(np.int64)
    samples, _ = decode_frames(np.frombuffer(stream, np.uint8), starts[lo:hi], np.append(starts, len(stream))[lo + 1 : hi + 1])
    return samples.tobytes()[first - begins[lo] : first - begins[lo] + count]


def _padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offs)
    full = np.maximum(-(-sizes // PAD), 1) * PAD
    ends = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(int(ends[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(ends[:-1] - offs[:-1], sizes)] = data
    return out, ends


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offs in text_chunks(batch.column(1), CHUNK):
            yield pa.record_batch([batch.column(0)[at:end], pa.array(np.diff(offs)), pa.array(encode(*_padded(data, offs)), pa.binary())], ["doc_id", "n_bytes", "media"])


def _runs(media: list[bytes]) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for k, stream in enumerate(media):
        if total and total + len(stream) > CHUNK:
            yield at, k
            at, total = k, 0
        total += len(stream)
    if at < len(media):
        yield at, len(media)


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2).to_pylist()
        for at, end in _runs(media):
            pcm = decode(media[at:end])
            points = [Stream(s).points["sample"].astype(np.int64) for s in media[at:end]]
            yield pa.record_batch([batch.column(0)[at:end], batch.column(1)[at:end], pa.array(media[at:end], pa.binary()), pa.array(pcm, pa.binary()), pa.array(points, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "media", "pcm", "offsets"])


def flac_encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 of each text, padded by zero bytes to a positive multiple of 64, as a stream.

    A null text counts as empty. Equal texts make equal streams. Repeated rows are coded one by one. Extra columns are not read.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary")


def flac_decode(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, pcm, offsets: the bytes read back from media (doc_id, n_bytes, media), and the first
    sample of each block that can be sought. Damaged streams raise an error."""
    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode_batches, "doc_id long, n_bytes long, media binary, pcm binary, offsets array<long>")


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _decode_batches(batches):
        for k in range(batch.num_rows):
            pcm, first = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
            n = len(first)
            yield pa.record_batch([pa.array([batch.column(0)[k].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(first, pa.int64()), pa.array([pcm[a:b] for a, b in zip(first, [*first[1:], len(pcm)], strict=True)], pa.binary())], ["doc_id", "block", "first_sample", "pcm"])


def flac_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, first_sample, pcm: the samples of media (doc_id, n_bytes, media) by blocks, a row each, so that any
    place can be read without the rest."""
    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_block_batches, "doc_id long, block long, first_sample long, pcm binary")


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for coded in _encode_batches(batches):
        for batch in _decode_batches(iter([coded])):
            rows = []
            for n, media, pcm, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
                feature = f"mean={int(x.sum()) / len(x):.6f};power={int((x * x).sum()) / len(x):.6f};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"
                rows.append((n, len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(first), first[-1]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks", "last_offset"])


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flac_encode and flac_decode in one pass over each batch, digests of what was read back, its blocks and the last one's first sample."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_digest_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, last_offset long")
