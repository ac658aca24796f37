"""Words of whole texts as numpy arrays, straight from Arrow's string buffers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return in the UTF-8 form of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LANE = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes at most.

    A single longer text is a run of its own.
    """
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one more at the end)."""
    gap = np.empty(len(data) + 2, np.bool_)
    gap[0] = gap[-1] = True
    np.take(_SPACE, data, out=gap[1:-1])
    change = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = change[0::2], change[1::2]
    # a word never crosses from one text to the next
    cuts = offsets[1:-1]
    if len(cuts) and len(starts):
        k = np.searchsorted(starts, cuts, "left") - 1
        crossed = np.unique(cuts[(k >= 0) & (ends[np.maximum(k, 0)] > cuts)])
        if len(crossed):
            starts = np.sort(np.concatenate([starts, crossed]))
            ends = np.sort(np.concatenate([ends, crossed]))
    first = np.searchsorted(starts, offsets, "left")
    first[-1] = len(starts)
    return starts, ends, first


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: equal words, equal names, on every executor.

    Eight bytes at a time are mixed in by a bijection that is not linear, so words of one length
    that differ in one such lane never share a name; long words take XXH64.
    """
    size = ends - starts
    salt = np.uint64(seed * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    name = size.astype(np.uint64) * _LANE + salt
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    if len(starts):  # words over LONG bytes are named below
        name = mix((name ^ lanes[starts] & _MASKS[np.minimum(size, 8)]) * _LANE + salt)
    live, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        lane = lanes[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]
        name[live] = mix((name[live] ^ lane) * _LANE + salt)
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        name[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], seed)
    return name
