"""FLAC streams: a decoder for all subframe kinds, an encoder, PCM blocks with sample offsets.

The decoder reads Rice residuals (both parameter sizes, escapes, partitions), constant, verbatim,
fixed and linear-predictor subframes, wasted bits and the three stereo kinds; it verifies each
frame's header and frame checksum, the seek points and the stream's MD5.  Frames are read one after
another; linear predictors are undone for many frames, of one stream or of several, at once.  What
comes out are PCM blocks with the number of their first sample and their place in the stream, so
that a block can be found by a sample's number.  The encoder writes mono streams with a seek table;
its linear predictors have order 2 and weights from exact integer sums, so that equal samples give
equal streams on every machine.

``store`` and ``read`` apply both to a table.  Results for odd input: a null text is an empty one;
an empty text is 64 zero bytes; rows with a null ``doc_id`` and repeated rows are kept; other
columns are ignored; a damaged stream raises ``FlacError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
RATE = 8000
UNIT = 64
ROWS = 128
GROUP = 256
PRECISION, SHIFT = 12, 10


class FlacError(ValueError):
    pass


def _table(poly: int, width: int) -> np.ndarray:
    value = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        value = np.where(value >> (width - 1) & 1, value << 1 ^ poly, value << 1) & (1 << width) - 1
    return value


_CRC8 = _table(0x07, 8).tolist()
_LONGEST = 8192
_far: list[np.ndarray] = []


def crc8(data: bytes) -> int:
    value = 0
    for x in data:
        value = _CRC8[value ^ x]
    return value


def crc16(data: np.ndarray) -> int:
    """By a table of what each byte adds at each distance from the end."""
    if not _far:
        first = _table(0x8005, 16)
        rows = [first]
        for _ in range(_LONGEST - 1):
            rows.append((rows[-1] << 8 & 0xFFFF) ^ first[rows[-1] >> 8])
        _far.extend([np.array(rows, np.uint16).reshape(-1), np.arange(_LONGEST - 1, -1, -1) << 8])
    value = 0
    for a in range(0, len(data), _LONGEST):
        part = data[a : a + _LONGEST].copy()
        part[0] ^= value >> 8
        rest = 0
        if len(part) > 1:
            part[1] ^= value & 255
        else:
            rest = (value & 255) << 8
        value = int(np.bitwise_xor.reduce(_far[0].take(_far[1][_LONGEST - len(part) :] + part))) ^ rest
    return value


def _coded_number(n: int) -> bytes:
    """A frame's number in the manner of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([~(lead << 1 | 1) & 0xFF | n, *reversed(tail)])


# --- encoder ---------------------------------------------------------------------------------


def _bits(value: int, width: int) -> np.ndarray:
    return np.array([value >> k & 1 for k in range(width - 1, -1, -1)], np.uint8)


def _weights(x: np.ndarray) -> list[int] | None:
    """The two weights of least squares, scaled by 2**SHIFT, from sums that are exact integers."""
    if len(x) < 16:
        return None
    y, a, b = x[2:], x[1:-1], x[:-2]
    aa, ab, bb, ay, by = (int(p @ q) for p, q in ((a, a), (a, b), (b, b), (a, y), (b, y)))
    below = aa * bb - ab * ab
    if below <= 0:
        return None
    out = [((top << (SHIFT + 1)) + below) // (2 * below) for top in (ay * bb - by * ab, by * aa - ay * ab)]
    most = 1 << (PRECISION - 1)
    return out if all(-most <= w < most for w in out) else None


def _subframe(x: np.ndarray, bits: int) -> np.ndarray:
    """The shortest of constant, verbatim, fixed predictors of order 0 to 2 and a linear one, as bits."""
    mask = (1 << bits) - 1
    if (x == x[0]).all():
        return np.concatenate([_bits(0, 8), _bits(int(x[0]) & mask, bits)])
    best, residual, order, d = None, x, 0, x
    for k in range(3):
        if len(x) > k:
            cost = int(np.abs(d).sum()) + k * (1 << (bits - 2))
            if best is None or cost < best:
                best, residual, order = cost, d, k
            d = np.diff(d)
    weights = _weights(x)
    if weights:
        d = x[2:] - (weights[0] * x[1:-1] + weights[1] * x[:-2] >> SHIFT)
        if int(np.abs(d).sum()) + 2 * (1 << (bits - 2)) + 4 * PRECISION < best:
            residual, order = d, 2
        else:
            weights = None
    u = residual << 1 ^ residual >> 63
    guess = max(0, int(u.sum() // max(1, len(u))).bit_length() - 1)
    size, k = min((int((u >> k).sum()) + len(u) * (k + 1), k) for k in range(max(0, min(14, guess) - 1), min(14, guess + 1) + 1))
    if size + order * bits + 10 + (9 + 2 * PRECISION if weights else 0) >= len(x) * bits:
        body = (x[:, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8).reshape(-1)
        return np.concatenate([_bits(2, 8), body])
    q = u >> k
    stop = np.cumsum(q + (k + 1)) - (k + 1)
    code = np.zeros(size, np.uint8)
    code[stop] = 1
    for b in range(k):
        code[stop + (b + 1)] = u >> (k - 1 - b) & 1
    warm = [_bits(int(v) & mask, bits) for v in x[:order]]
    if weights:
        scale = [_bits(PRECISION - 1, 4), _bits(SHIFT, 5), *(_bits(w & (1 << PRECISION) - 1, PRECISION) for w in weights)]
        return np.concatenate([_bits((32 | order - 1) << 1, 8), *warm, *scale, _bits(0, 6), _bits(k, 4), code])
    return np.concatenate([_bits((8 | order) << 1, 8), *warm, _bits(0, 6), _bits(k, 4), code])


def encode(samples: np.ndarray, bits: int = 8, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono stream of signed samples."""
    samples = samples.astype(np.int64)
    size_code = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[bits]
    frames, points, at = [], [], 0
    for number, a in enumerate(range(0, len(samples), block)):
        x = samples[a : a + block]
        head = b"\xff\xf8" + bytes([0x70, size_code << 1]) + _coded_number(number) + struct.pack(">H", len(x) - 1)
        body = head + bytes([crc8(head)]) + np.packbits(_subframe(x, bits)).tobytes()
        body += struct.pack(">H", crc16(np.frombuffer(body, np.uint8)))
        points.append(struct.pack(">QQH", a, at, len(x)))
        frames.append(body)
        at += len(body)
    sizes = [len(f) for f in frames] or [0]
    width = (bits + 7) // 8
    digest = hashlib.md5(samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes(), usedforsecurity=False).digest()
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (rate << 44 | 0 << 41 | (bits - 1) << 36 | len(samples)).to_bytes(8, "big") + digest
    seek = b"".join(points)
    return b"".join([b"fLaC", bytes([0]), len(info).to_bytes(3, "big"), info, bytes([0x80 | 3]), len(seek).to_bytes(3, "big"), seek, *frames])


# --- decoder ---------------------------------------------------------------------------------


class Stream:
    """What a stream's metadata say: rate, channels, bits, samples, MD5, seek points, first frame."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise FlacError("no FLAC marker")
        self.data, at, last = data, 4, False
        self.points: list[tuple[int, int, int]] = []
        self.rate = None
        while not last:
            if at + 4 > len(data):
                raise FlacError("metadata end early")
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if len(body) < size:
                raise FlacError("metadata end early")
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.block, self.md5 = struct.unpack(">H", body[2:4])[0], body[18:34]
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
            at += 4 + size
        if self.rate is None:
            raise FlacError("no stream information")
        self.start = at


class _Reader:
    """Bits of the bytes from a place on, unpacked a window at a time."""

    def __init__(self, data: bytes, at: int, window: int):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8, min(window, len(data) - at), at))
        self.text = self.bits.tobytes()
        self.at = 0

    def uint(self, width: int) -> int:
        part = self.text[self.at : self.at + width]
        if len(part) < width:
            raise FlacError("a frame ends early")
        self.at += width
        return int(part.translate(_DIGITS), 2) if width else 0

    def sint(self, width: int) -> int:
        value = self.uint(width)
        return value - (1 << width) if width and value >> (width - 1) else value

    def sints(self, count: int, width: int) -> np.ndarray:
        if width == 0:
            return np.zeros(count, np.int64)
        part = self.bits[self.at : self.at + count * width]
        if len(part) < count * width:
            raise FlacError("a frame ends early")
        self.at += count * width
        value = np.zeros(count, np.int64)
        part = part.reshape(count, width)
        for k in range(width):
            value = value << 1 | part[:, k]
        return np.where(value >> (width - 1), value - (1 << width), value)

    def rice(self, count: int, k: int) -> np.ndarray:
        if not count:
            return np.zeros(0, np.int64)
        span, stop = count * (k + 3) + 64, None
        while stop is None:
            stop = _stops(self.bits[self.at : self.at + span], count, k)
            if stop is None and self.at + span >= len(self.bits):
                raise FlacError("a frame ends early")
            span *= 2
        stop += self.at
        start = np.empty_like(stop)
        start[0], start[1:] = self.at, stop[:-1] + (1 + k)
        self.at = int(stop[-1]) + 1 + k
        if self.at > len(self.text):
            raise FlacError("a frame ends early")
        u = stop - start
        for b in range(k):
            u = u << 1 | self.bits[stop + (1 + b)]
        return u >> 1 ^ -(u & 1)


def _stops(bits: np.ndarray, count: int, k: int) -> np.ndarray | None:
    """Where the unary parts of ``count`` codes end, None if the bits do not hold so many.  The next end is
    the first set bit after the k bits that follow one; twice as many are found with each doubled jump."""
    ones = np.flatnonzero(bits)
    before = np.zeros(len(bits) + 1, np.int64)
    np.cumsum(bits, out=before[1:])
    jump = np.append(before[np.minimum(ones + (1 + k), len(bits))], len(ones))
    at = np.zeros(1, np.int64)
    while len(at) < count:
        at = np.concatenate([at, jump[at]])
        if len(at) < count:
            jump = jump[jump]
    at = at[:count]
    return ones[at] if at[-1] < len(ones) else None


_DIGITS = bytes(48 + (x & 1) for x in range(256))


def _residual(r: _Reader, block: int, order: int) -> np.ndarray:
    method = r.uint(2)
    if method > 1:
        raise FlacError("unknown residual coding")
    parameter = 4 + method
    parts = r.uint(4)
    if block & (1 << parts) - 1 or block >> parts < order:
        raise FlacError("partitions do not fit the block")
    out = []
    for p in range(1 << parts):
        count = (block >> parts) - (order if p == 0 else 0)
        k = r.uint(parameter)
        out.append(r.sints(count, r.uint(5)) if k == (1 << parameter) - 1 else r.rice(count, k))
    return np.concatenate(out)


def _fixed(warm: list[int], residual: np.ndarray) -> np.ndarray:
    """Undoes the order-th difference, where order is the number of first samples."""
    if not warm:
        return residual
    heads, d = [], np.array(warm, np.int64)
    while len(d):
        heads.append(int(d[-1]))
        d = np.diff(d)
    for head in reversed(heads):
        residual = np.cumsum(residual) + head
    return np.concatenate([np.array(warm, np.int64), residual])


class _Linear:
    """A channel whose linear predictor is still to be undone."""

    def __init__(self, warm: list[int], residual: np.ndarray, weights: list[int], shift: int):
        self.warm, self.residual, self.weights, self.shift = warm, residual, weights, shift
        self.wasted, self.samples = 0, None


def _undo(channels: list[_Linear]) -> None:
    """Undoes the predictors of many channels together, sample by sample over all of them.

    Channels are sorted by length, so that at each sample those that have ended are a tail."""
    by_order: dict[int, list[_Linear]] = {}
    for c in channels:
        by_order.setdefault(len(c.warm), []).append(c)
    for order, found in by_order.items():
        found.sort(key=lambda c: -len(c.residual))
        sizes = np.array([len(c.residual) for c in found])
        out = np.zeros((order + int(sizes[0]), len(found)), np.int64)
        for n, c in enumerate(found):
            out[:order, n] = c.warm
            out[order : order + len(c.residual), n] = c.residual
        weights = [np.array([c.weights[k] for c in found], np.int64) for k in range(order)]
        shift = np.array([c.shift for c in found], np.int64)
        more = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        for live in np.unique(more)[::-1].tolist():
            now = np.flatnonzero(more == live) + order
            ws, by = [w[:live] for w in weights], shift[:live]
            past = [out[t, :live] for t in range(int(now[0]) - 1, int(now[0]) - 1 - order, -1)]
            for t in range(int(now[0]), int(now[-1]) + 1):
                total = ws[0] * past[0]
                for w, x in zip(ws[1:], past[1:]):
                    total += w * x
                total >>= by
                row = out[t, :live]
                row += total
                past = [row, *past[:-1]]
        for n, c in enumerate(found):
            c.samples = out[: order + len(c.residual), n] << c.wasted


def _channel(r: _Reader, block: int, bits: int) -> np.ndarray | _Linear:
    if r.uint(1):
        raise FlacError("a subframe starts with a set bit")
    kind, wasted = r.uint(6), 0
    if r.uint(1):
        wasted = 1
        while not r.uint(1):
            wasted += 1
    bits -= wasted
    if kind == 0:
        out = np.full(block, r.sint(bits), np.int64)
    elif kind == 1:
        out = r.sints(block, bits)
    elif 8 <= kind <= 12:
        warm = [r.sint(bits) for _ in range(kind - 8)]
        out = _fixed(warm, _residual(r, block, kind - 8))
    elif kind >= 32:
        warm = [r.sint(bits) for _ in range(kind - 31)]
        precision = r.uint(4) + 1
        if precision == 16:
            raise FlacError("reserved precision")
        shift = r.sint(5)
        if shift < 0:
            raise FlacError("negative shift")
        weights = [r.sint(precision) for _ in warm]
        out = _Linear(warm, _residual(r, block, len(warm)), weights, shift)
        out.wasted = wasted
        return out
    else:
        raise FlacError("reserved subframe kind")
    return out << wasted


class _Frame:
    """A frame as read: its first sample, its channels, how they are paired, its place and end."""

    def __init__(self, first: int, size: int, channels: list, kind: int, at: int, end: int):
        self.first, self.size, self.channels, self.kind, self.at, self.end = first, size, channels, kind, at, end

    def samples(self) -> np.ndarray:
        """Samples by channel, once linear predictors are undone."""
        out = [c.samples if isinstance(c, _Linear) else c for c in self.channels]
        if self.kind == 8:
            out[1] = out[0] - out[1]
        elif self.kind == 9:
            out[0] = out[0] + out[1]
        elif self.kind == 10:
            middle = out[0] << 1 | out[1] & 1
            out = [middle + out[1] >> 1, middle - out[1] >> 1]
        return np.stack(out)


def _frame(s: Stream, at: int) -> _Frame:
    data = s.data
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError(f"no frame at byte {at}")
    size, rate, kind, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    p = at + 4
    lead = data[p]
    more = 0 if lead < 0x80 else 7 - (~lead & 0xFF).bit_length()
    number = lead if not more else lead & (1 << (6 - more)) - 1
    for x in data[p + 1 : p + 1 + more]:
        number = number << 6 | x & 0x3F
    p += 1 + more
    if size in (6, 7):
        block = int.from_bytes(data[p : p + size - 5], "big") + 1
        p += size - 5
    elif size == 1:
        block = 192
    elif 2 <= size <= 5:
        block = 576 << (size - 2)
    elif size >= 8:
        block = 256 << (size - 8)
    else:
        raise FlacError("reserved block size")
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        raise FlacError(f"header checksum differs at byte {at}")
    bits = s.bits if depth == 0 else {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(depth)
    if bits is None or kind > 10:
        raise FlacError("reserved frame header")
    channels = kind + 1 if kind < 8 else 2
    r = _Reader(data, p + 1, (block * channels * (bits + 2)) // 8 * 2 + 4096)
    out = []
    for c in range(channels):
        side = kind == 8 and c == 1 or kind == 9 and c == 0 or kind == 10 and c == 1
        out.append(_channel(r, block, bits + side))
    end = p + 1 + (r.at + 7) // 8
    if len(data) < end + 2 or crc16(np.frombuffer(data, np.uint8, end - at, at)) != int.from_bytes(data[end : end + 2], "big"):
        raise FlacError(f"frame checksum differs at byte {at}")
    first = number if data[at + 1] & 1 else number * s.block
    return _Frame(first, block, out, kind, at, end + 2)


def _blocks(streams: Iterable[tuple[object, Stream, int]], group: int) -> Iterator[tuple[object, _Frame]]:
    """(key, frame) of every frame from the given place in each stream on, in order; predictors are
    undone for ``group`` frames at a time, fewer if they are long, which bounds what is held."""
    held: list[tuple[object, _Frame]] = []
    longest = 0

    def settle():
        _undo([c for _, f in held for c in f.channels if isinstance(c, _Linear)])
        yield from held
        held.clear()

    for key, s, at in streams:
        points = {p[0]: p[1] for p in s.points}
        while at < len(s.data):
            f = _frame(s, at)
            if points.get(f.first, at - s.start) != at - s.start:
                raise FlacError(f"a seek point does not lead to the frame at byte {at}")
            held.append((key, f))
            at, longest = f.end, max(longest, f.size)
            if len(held) >= group or len(held) * longest >= GROUP * BLOCK:
                yield from settle()
                longest = 0
    yield from settle()


def frames(data: bytes, sample: int = 0, group: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(first sample, samples by channel) of each frame from the one that holds ``sample`` on."""
    s = Stream(data)
    at = s.start + max([(0, 0), *((p[0], p[1]) for p in s.points if p[0] <= sample)])[1]
    for _, f in _blocks([(None, s, at)], group):
        found = f.samples()
        if f.first + found.shape[1] > sample:
            yield f.first, found


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Little-endian PCM, channels in turn, in as few bytes a sample as ``bits`` need."""
    return np.ascontiguousarray(samples.T).astype("<i4").view(np.uint8).reshape(-1, 4)[:, : (bits + 7) // 8].tobytes()


class _Whole:
    """Checks that a stream's blocks follow one another and agree with its MD5 and length."""

    def __init__(self, s: Stream):
        self.stream, self.next, self.md5 = s, 0, hashlib.md5(usedforsecurity=False)

    def add(self, first: int, count: int, raw: bytes) -> None:
        if first != self.next:
            raise FlacError(f"sample {self.next} is missing")
        self.next += count
        self.md5.update(raw)

    def end(self) -> None:
        s = self.stream
        if any(s.md5) and self.md5.digest() != s.md5 or s.samples not in (0, self.next):
            raise FlacError("the stream's MD5 or length differs")


def decode(data: bytes) -> tuple[Stream, np.ndarray]:
    """All samples by channel; the stream's MD5 must agree."""
    s = Stream(data)
    whole, parts = _Whole(s), []
    for first, found in frames(data, group=GROUP):
        whole.add(first, found.shape[1], pcm(found, s.bits))
        parts.append(found)
    whole.end()
    return s, np.concatenate(parts, axis=1) if parts else np.zeros((s.channels, 0), np.int64)


# --- tables ----------------------------------------------------------------------------------


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a FLAC stream of 8-bit samples."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                media = [encode(np.frombuffer(payload(t), np.uint8).astype(np.int64) - 128) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


class Feature:
    """Mean, root mean square, peak, sign changes and flatness of the sample histogram, gathered
    block by block in whole numbers."""

    def __init__(self):
        self.count, self.changes, self.last = np.zeros(256, np.int64), 0, None

    def add(self, samples: np.ndarray) -> None:
        self.count += np.bincount(samples + 128, minlength=256)
        below = samples < 0
        self.changes += int((below[1:] != below[:-1]).sum()) + (self.last is not None and bool(below[0]) != self.last)
        self.last = bool(below[-1])

    def text(self) -> str:
        n, level = int(self.count.sum()), np.arange(-128, 128)
        share = self.count[self.count > 0] / n
        entropy = -float((share * np.log2(share)).sum()) + 0.0
        mean, power = int((self.count * level).sum()) / n, int((self.count * level * level).sum()) / n
        return f"mean={mean:.4f};rms={power**0.5:.4f};peak={int(np.abs(level[self.count > 0]).max())};changes={self.changes};entropy={entropy:.4f}"


def blocks(part: list[tuple[object, bytes]]) -> Iterator[tuple[object, Stream, int, _Frame | None, np.ndarray | None, bytes]]:
    """(key, stream, number, frame, samples, PCM) of every block of several streams in order, and
    after each stream's last block once (key, stream, number of blocks, None, None, b"").  A stream
    is checked against its MD5 before its end is told."""
    streams = [Stream(data) for _, data in part]
    wholes, at, number = [_Whole(s) for s in streams], 0, 0

    def end(until):
        nonlocal at, number
        while at < until:
            wholes[at].end()
            yield part[at][0], streams[at], number, None, None, b""
            at, number = at + 1, 0

    for n, f in _blocks(((n, s, s.start) for n, s in enumerate(streams)), GROUP):
        yield from end(n)
        samples = f.samples()
        raw = pcm(samples, streams[n].bits)
        wholes[n].add(f.first, samples.shape[1], raw)
        yield part[n][0], streams[n], number, f, samples, raw
        number += 1
    yield from end(len(part))


_POINTS = pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int64()), ("byte_offset", pa.int64()), ("pcm_crc32", pa.int64())]))
_READ = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "blocks array<struct<first_sample:bigint,n_samples:bigint,byte_offset:bigint,pcm_crc32:bigint>>"
)


def read(media: DataFrame) -> DataFrame:
    """Decodes stored streams into PCM blocks and gives their digests, features and ``blocks``: for
    each block its first sample, samples, place in the stream and the CRC-32 of its PCM."""

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _POINTS)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                data = part.column("media").to_pylist()
                rows, sha, gathered, size, tail, points = [], hashlib.sha256(), Feature(), 0, b"", []
                for n, _, _, f, samples, raw in blocks(list(enumerate(data))):
                    if f is None:
                        rows.append((size, sha.hexdigest(), zlib.crc32(tail), len(data[n]), hashlib.sha256(data[n]).hexdigest(), gathered.text(), points))
                        sha, gathered, size, tail, points = hashlib.sha256(), Feature(), 0, b"", []
                        continue
                    own = (samples[0] + 128).astype(np.uint8).tobytes()
                    sha.update(own)
                    gathered.add(samples[0])
                    tail = (tail + own)[-UNIT:]
                    points.append({"first_sample": size, "n_samples": len(own), "byte_offset": f.at, "pcm_crc32": zlib.crc32(raw)})
                    size += len(own)
                columns = list(zip(*rows)) if rows else [()] * len(kinds)
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "blocks"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return media.mapInArrow(run, _READ)


def pcm_blocks(media: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """``id, block, first_sample, n_samples, byte_offset, pcm`` for each frame of each stream that
    is not null; ``byte_offset`` is the frame's place in the stream."""

    def run(batches):
        names = ["id", "block", "first_sample", "n_samples", "byte_offset", "pcm"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            pairs = list(zip(batch.column("id").to_pylist(), batch.column("media").to_pylist()))
            for a in range(0, len(pairs), ROWS):
                for i, _, n, f, samples, raw in blocks([p for p in pairs[a : a + ROWS] if p[1] is not None]):
                    if f is not None:
                        row = (i, n, f.first, samples.shape[1], f.at, raw)
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    rows = media.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).alias("media"))
    return rows.mapInArrow(run, "id bigint, block int, first_sample bigint, n_samples bigint, byte_offset bigint, pcm binary")
