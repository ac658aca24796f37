import hashlib
import struct
import zlib

import numpy as np
import pytest

from quillspark.llm import flac as A


def slow_crc16(data):
    value = 0
    for x in data:
        value ^= x << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005) & 0xFFFF if value & 0x8000 else value << 1
    return value


def test_checksums():
    assert A.crc8(b"123456789") == 0xF4 and A.crc16(np.frombuffer(b"123456789", np.uint8)) == 0xFEE8
    rng = np.random.default_rng(0)
    for n in (1, 2, 8191, 8192, 8193, 8194, 17000):
        d = rng.integers(0, 256, n).astype(np.uint8)
        assert A.crc16(d) == slow_crc16(d.tolist())


@pytest.mark.parametrize("bits", [8, 16, 24])
def test_round_trip(bits):
    rng, top = np.random.default_rng(bits), 1 << (bits - 1)
    for n in (1, 3, 64, 4096, 4097, 9000):
        for x in (rng.integers(-top, top, n), np.full(n, -top), (top * 0.9 * np.sin(np.arange(n) / 40)).astype(int), np.cumsum(rng.integers(-1, 2, n)) % top):
            stream, got = A.decode(A.encode(x, bits))
            assert stream.bits == bits and (got[0] == x).all()


class Bits:
    def __init__(self):
        self.out = []

    def put(self, value, width):
        self.out += [value >> k & 1 for k in range(width - 1, -1, -1)]

    def rice(self, v, k):
        u = v << 1 if v >= 0 else -v * 2 - 1
        self.out += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)

    def frame(self, head):
        self.out += [0] * (-len(self.out) % 8)
        body = head + bytes([A.crc8(head)]) + np.packbits(self.out).tobytes()
        return body + struct.pack(">H", slow_crc16(body))


def stream(frame, channels, bits, samples, block):
    info = struct.pack(">HH", block, block) + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + frame


def test_linear_predictor_partitions_escape_and_side_channel():
    left = [10, 12, 15, 19, 22, 27, 30, 36]
    right = [8, 12, 12, 16, 20, 24, 28, 32]
    side = [a - b for a, b in zip(left, right)]
    b = Bits()
    b.put(0, 1), b.put(32 + 1, 6), b.put(0, 1)  # order 2
    for v in left[:2]:
        b.put(v & 0xFFFF, 16)
    b.put(4, 4), b.put(1, 5), b.put(3 & 31, 5), b.put(-1 & 31, 5)  # 5-bit weights 3, -1, shift 1
    residual = [left[t] - ((3 * left[t - 1] - left[t - 2]) >> 1) for t in range(2, 8)]
    b.put(1, 2), b.put(1, 4)  # 5-bit parameters, two partitions
    b.put(2, 5)
    for v in residual[:2]:
        b.rice(v, 2)
    b.put(31, 5), b.put(9, 5)
    for v in residual[2:]:
        b.put(v & 511, 9)
    b.put(0, 1), b.put(1, 6), b.put(1, 1), b.put(1, 1)  # verbatim side, one wasted bit
    side = [s * 2 for s in side]
    left = left[:]
    for v in side:
        b.put(v >> 1 & 0xFFFF, 16)
    head = b"\xff\xf8" + bytes([0x60, 0x80 | 4 << 1]) + b"\0" + bytes([7])
    got = A.decode(stream(b.frame(head), 2, 16, 8, 8))[1]
    assert got[0].tolist() == left and got[1].tolist() == [a - s for a, s in zip(left, side)]


def plain_linear(warm, residual, weights, shift):
    out = list(warm)
    for r in residual:
        out.append(r + (sum(w * x for w, x in zip(weights, reversed(out))) >> shift))
    return out


def test_predictors_are_undone_together_as_one_by_one():
    rng = np.random.default_rng(5)
    channels = []
    for n in (0, 1, 7, 7, 300, 4000, 4000, 20):
        for order in (1, 2, 5):
            channels.append(A._Linear(rng.integers(-99, 99, order).tolist(), rng.integers(-9, 9, n), rng.integers(-300, 300, order).tolist(), 10))
    order = rng.permutation(len(channels))
    A._undo([channels[k] for k in order])
    for c in channels:
        assert c.samples.tolist() == plain_linear(c.warm, c.residual.tolist(), c.weights, c.shift)


def test_texts_meet_linear_frames_among_others():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).tolist()) for _ in range(50)]
    prose = [b" ".join(words[k] for k in rng.integers(0, 50, n)) for n in (3, 40, 900, 5000)]
    waves = [bytes((128 + 90 * np.sin(np.arange(n) / 9)).astype(np.uint8).tolist()) for n in (200, 9000)]
    data = [A.encode(np.frombuffer(A.payload(t), np.uint8).astype(np.int64) - 128) for t in (*prose, *waves, b"")]
    linear, got = 0, {}
    for key, s, number, f, samples, raw in A.blocks(list(enumerate(data))):
        if f is None:
            assert number == len(got.get(key, ()))
            continue
        linear += isinstance(f.channels[0], A._Linear)
        assert (f.first, f.at - s.start, f.size) == s.points[number] and raw == samples[0].astype(np.int8).tobytes()
        got.setdefault(key, []).append(samples[0])
    assert 3 <= linear < sum(map(len, got.values()))
    for key, t in enumerate((*prose, *waves, b"")):
        assert (np.concatenate(got[key]) + 128).astype(np.uint8).tobytes() == A.payload(t)
    swapped = bytearray(data[3])
    at = A.Stream(data[3]).start - len(A.Stream(data[3]).points) * 18 + 18 + 15  # low byte of the second point's place
    swapped[at] ^= 1
    with pytest.raises(A.FlacError, match="seek point"):
        A.decode(bytes(swapped))


def test_middle_side():
    left, right = [5, -3, 7, 8], [2, -8, 7, 1]
    b = Bits()
    for values, width in (([(x + y) >> 1 for x, y in zip(left, right)], 16), ([x - y for x, y in zip(left, right)], 17)):
        b.put(1 << 1, 8)
        for v in values:
            b.put(v & (1 << width) - 1, width)
    head = b"\xff\xf8" + bytes([0x60, 0xA0 | 4 << 1]) + b"\0" + bytes([3])
    assert A.decode(stream(b.frame(head), 2, 16, 4, 4))[1].tolist() == [left, right]


def test_damage_is_found_and_blocks_are_seekable():
    x = np.random.default_rng(3).integers(-128, 128, 9000)
    data = A.encode(x)
    for at in (3, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 16
        with pytest.raises(A.FlacError):
            A.decode(bytes(bad))
    with pytest.raises(A.FlacError):
        A.decode(data[:-5])
    first, found = next(A.frames(data, 5000))
    assert first == 4096 and (found[0] == x[4096:8192]).all()


def test_tables(odd, odd_rows, empty):
    media = A.store(odd)
    got = A.read(media).collect()
    want = []
    for d, t in odd_rows:
        raw = (t or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    stored = {r.doc_id: r.media for r in media.collect()}
    for r in got:
        at = [(b.first_sample, b.n_samples) for b in r.blocks]
        assert at == [(k, min(A.BLOCK, r.payload_bytes - k)) for k in range(0, r.payload_bytes, A.BLOCK)]
        first, found = next(A.frames(stored[r.doc_id], r.payload_bytes - 1))
        assert first == r.blocks[-1].first_sample and zlib.crc32(A.pcm(found, 8)) == r.blocks[-1].pcm_crc32
        assert stored[r.doc_id][r.blocks[-1].byte_offset :][:2] == b"\xff\xf8"
    assert all(r.media_bytes == len(stored[r.doc_id]) and r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest() for r in got)
    assert len({r.feature for r in got if r.doc_id in (1, 2, None)}) == 1
    blocks = {}
    for r in A.pcm_blocks(media.where("doc_id = 10")).collect():
        blocks[r.first_sample] = r.pcm
    whole = b"".join(blocks[k] for k in sorted(blocks))
    assert bytes((np.frombuffer(whole, np.int8).astype(int) + 128).astype(np.uint8))[: len(dict(odd_rows)[10])] == dict(odd_rows)[10].encode()
    assert A.read(A.store(empty)).collect() == []
