"""Ratcliff-Obershelp ratio of two strings, in Arrow batches; Spark has no such expression.

The blocks that the ratio counts are in order in both strings, so it is at most twice the longest
common subsequence over both lengths.  That is found for many pairs at once, one bit for each
character, and only pairs that it lets through are compared by the slow rule.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

WIDE = 16  # words of 64 bits; longer strings are taken one pair at a time
CELLS = 1 << 21


@F.arrow_udf(DoubleType())
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Twice the matching characters over all characters; argument order matters."""
    out, matcher, last = [], SequenceMatcher(None), None
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:  # the second string is indexed once for a run of firsts
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pa.array(out, pa.float64())


def _one(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit of a whole number for each character of a."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _many(a: list[str], b: list[str]) -> np.ndarray:
    pairs, n, m = len(a), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    w = max(1, -(-int(n.max()) // 64))
    codes = np.frombuffer("".join(a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, codes = np.unique(codes, return_inverse=True)
    masks = np.zeros((pairs, len(letters) + 1, w), np.uint64)
    row, place = np.repeat(np.arange(pairs), n), np.concatenate([np.arange(k) for k in n])
    np.add.at(masks, (row, codes[: n.sum()], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    other = np.full((pairs, int(m.max())), len(letters))
    other[np.repeat(np.arange(pairs), m), np.concatenate([np.arange(k) for k in m])] = codes[n.sum() :]
    v, each = np.full((pairs, w), ~np.uint64(0)), np.arange(pairs)
    for j in range(other.shape[1]):
        u = v & masks[each, other[:, j]]
        total = v + u
        if w > 1:  # carries go from word to word
            carry = total < u
            for k in range(1, w):
                total[:, k] += carry[:, k - 1]
                carry[:, k] |= carry[:, k - 1] & (total[:, k] == 0)
        v = total | v - u
    # bits above a string's length stay set
    return w * 64 - np.bitwise_count(v).sum(1).astype(np.int64)


def common(a: list[str], b: list[str]) -> np.ndarray:
    """The lengths of the longest common subsequences of pairs."""
    out = np.zeros(len(a), np.int64)
    order = sorted((k for k in range(len(a)) if a[k] and b[k]), key=lambda k: (len(a[k]), len(b[k])))
    while order:
        w = -(-len(a[order[0]]) // 64)
        if w > WIDE:
            for k in order:
                out[k] = _one(a[k], b[k])
            break
        most = max(1, CELLS // (64 * w))
        part = [k for k in order[:most] if -(-len(a[k]) // 64) <= 2 * w]
        out[part] = _many([a[k] for k in part], [b[k] for k in part])
        order = order[len(part) :]
    return out


def ratios(a: list[str | None], b: list[str | None], threshold: float) -> list[float | None]:
    """The ratio of each pair that reaches the threshold, else None."""
    a, b = [x or "" for x in a], [y or "" for y in b]
    size = np.array([len(x) + len(y) for x, y in zip(a, b)])
    able = 2 * common(a, b) >= threshold * size - 1e-9
    out: list[float | None] = [None] * len(a)
    for k in np.flatnonzero(able & (size > 0)).tolist():
        out[k] = ratio_of(a[k], b[k], threshold)
    return out


@lru_cache(1 << 12)
def _rare(text: str) -> dict[str, list[int]]:
    """The places of the characters that difflib does not take for popular."""
    seen, at = Counter(text), defaultdict(list)
    rare = {c for c, n in seen.items() if n <= len(text) // 100 + 1}
    for k, c in enumerate(text):
        if c in rare:
            at[c].append(k)
    return dict(at)


@lru_cache(64)
def _places(text: str) -> dict[str, list[int]]:
    at = defaultdict(list)
    for k, c in enumerate(text):
        at[c].append(k)
    return at


def _same(a: str, b: str, i: int, j: int, most: int, step: int) -> int:
    """How many characters, ``most`` at most, are equal from two places on, or before them."""
    n, k = 0, 1
    while n < most:  # strides double, then halve to the first difference
        k = min(k, most - n)
        x, y = (i + n, j + n) if step > 0 else (i - n - k, j - n - k)
        if a[x : x + k] == b[y : y + k]:
            n, k = n + k, 2 * k
        elif k == 1:
            break
        else:
            most, k = n + k - 1, max(1, k // 2)
    return n


def ratio_of(a: str, b: str, least: float) -> float | None:
    """difflib's ratio if it is ``least`` or more, else None.

    In a second string of 200 characters or more difflib starts from characters that are not popular in
    it.  Only their places are looked at here, and a pair is left when what may still match is too little.
    """
    if len(b) < 200:
        score = SequenceMatcher(None, a, b).ratio()
        return score if score >= least else None
    size, rare, own = len(a) + len(b), _rare(b), _places(a)
    if sum(map(len, rare.values())) > len(b) // 4:
        score = SequenceMatcher(None, a, b).ratio()
        return score if score >= least else None
    met = sorted([(i, j) for c, places in rare.items() if c in own for i in own[c] for j in places])
    todo, sure, able = [(0, len(a), 0, len(b), met)], 0, min(len(a), len(b))
    while todo:
        if 2.0 * able / size < least:
            return None
        alo, ahi, blo, bhi, own = todo.pop()
        able -= min(ahi - alo, bhi - blo)
        i, j, n, runs = alo, blo, 0, {}
        for x, y in own:
            runs[x, y] = k = runs.get((x - 1, y - 1), 0) + 1
            if k > n:
                i, j, n = x - k + 1, y - k + 1, k
        back = _same(a, b, i, j, min(i - alo, j - blo), -1)
        i, j, n = i - back, j - back, n + back
        n += _same(a, b, i + n, j + n, min(ahi - i - n, bhi - j - n), 1)
        if n:
            sure, able = sure + n, able + n
            for lo, hi, low, high in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)):
                if lo < hi and low < high:
                    inner = [(x, y) for x, y in own if lo <= x < hi and low <= y < high]
                    if inner:
                        able += min(hi - lo, high - low)
                        todo.append((lo, hi, low, high, inner))
                    elif a[lo] == b[low]:  # nothing else is found there
                        rest = _same(a, b, lo, low, min(hi - lo, high - low), 1)
                        sure, able = sure + rest, able + rest
    score = 2.0 * sure / size
    return score if score >= least else None


def ratio_from(threshold: float):
    """``ratio`` where it reaches the threshold, else null."""

    @F.arrow_udf(DoubleType())
    def found(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(ratios(a.to_pylist(), b.to_pylist(), threshold), pa.float64())

    return found


def grams(q: int, known: np.ndarray | None = None, seen: np.ndarray | None = None):
    """Hashes of a string's runs of ``q`` characters, each with the number of its occurrence.

    With ``known`` hashes (sorted) and how often each was ``seen``, the rarest come first; other hashes
    count as seen by none, and equally rare ones are in the order of the hashes.
    """

    @F.arrow_udf(ArrayType(LongType()))
    def found(a: pa.Array) -> pa.Array:
        import xxhash

        out = []
        for x in a.to_pylist():
            many = Counter((x or "")[k : k + q] for k in range(len(x or "") - q + 1))
            own = np.array([xxhash.xxh64_intdigest(f"{k}:{g}".encode("utf-8", "surrogatepass")) - (1 << 63) for g, n in many.items() for k in range(n)], np.int64)
            if known is not None and len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                own = own[np.lexsort((own, np.where(known[at] == own, seen[at], 0)))]
            out.append(own if known is None or len(known) else np.sort(own))
        return pa.array(out, pa.list_(pa.int64()))

    return found
