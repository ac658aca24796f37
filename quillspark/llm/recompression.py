"""Recompression of word sequences: runs and pairs of symbols become symbols, round by round.

A symbol's name is a 64-bit hash of what it was made from, so each round names equal runs and
equal pairs alike on all executors without an exchange.  Beside its name every symbol keeps the
words ``[low, high)`` that its making depended on (its own words and the neighbours that settled
whether it was joined).  Wherever those words recur, the same symbol stands at the same place.
A window of words therefore holds the same *settled* symbols (those with ``[low, high)`` inside
it) at each of its occurrences, and ``anchors`` gives each window one of them as its key.
"""

from __future__ import annotations

import numpy as np

from quillspark.llm import words as W

ROUNDS = 4
WORD, RUN, PAIR = 0, 1, 2
_RUN = np.uint64(0xA0761D6478BD642F)
_PAIR = np.uint64(0xE7037ED1A0B428DB)
_UP = np.uint64(0x8EBC6AF09C88C6E3 | 1)
_UP2 = np.uint64(0x589965CC75374CC3 | 1)


class Round:
    """Symbols of one round in text order: name, words [low, high) that settle it, their text.

    ``at`` is the first word of each symbol, ``first`` has the first word of each text and, at its
    end, the number of words.  ``made`` tells which symbols the round named, and of what: a pair
    of names, or a name and how often it is repeated.
    """

    __slots__ = ("name", "low", "high", "text", "first", "at", "made")

    def __init__(self, name, low, high, text, first, at, made=None):
        self.name, self.low, self.high, self.text, self.first, self.at, self.made = name, low, high, text, first, at, made


def first_round(name: np.ndarray, first: np.ndarray) -> Round:
    at = np.arange(len(name), dtype=np.int64)
    return Round(name, at, at + 1, np.repeat(np.arange(len(first) - 1), np.diff(first)), first, at)


def _neighbours(r: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the next symbol is of the same text, and low and high of the symbols beside each.

    At an end of a text the words that settle a symbol reach one over the end, so that no window
    holds them all.
    """
    same = r.text[1:] == r.text[:-1]
    left, right = r.first[r.text] - 1, r.first[r.text + 1] + 1
    left[1:][same] = r.low[:-1][same]
    right[:-1][same] = r.high[1:][same]
    return same, left, right


def runs(r: Round) -> Round:
    """Each longest run of one symbol becomes a symbol; it is settled with its neighbours."""
    same, left, right = _neighbours(r)
    first = np.flatnonzero(np.concatenate([[True], ~(same & (r.name[1:] == r.name[:-1]))]))
    last = np.concatenate([first[1:], [len(r.name)]]) - 1
    many = last - first + 1
    name = r.name[first].copy()
    long = many > 1
    name[long] = W.mix(name[long] * _UP + many[long].astype(np.uint64) * _RUN)
    where = np.flatnonzero(long)
    return Round(name, left[first], right[last], r.text[first], r.first, r.at[first], (where, RUN, r.name[first][where], many[where].astype(np.uint64)))


def pairs(r: Round, number: int) -> Round:
    """A bit of each name, other in each round, deals the symbols to two classes; a symbol of the
    one before a symbol of the other is joined with it."""
    same, left, right = _neighbours(r)
    bit = ((W.mix(r.name + np.uint64((number * int(_PAIR)) & (1 << 64) - 1)) >> np.uint64(17)) & np.uint64(1)).astype(np.bool_)
    joined = same & ~bit[:-1] & bit[1:]
    opens = np.concatenate([joined, [False]])
    closes = np.concatenate([[False], joined])
    low = np.where(bit, left, r.low)
    high = np.where(bit, r.high, right)
    at = np.flatnonzero(opens)
    name = r.name.copy()
    name[at] = W.mix((r.name[at] * _UP) ^ W.mix(r.name[at + 1] + _PAIR))
    low[at] = r.low[at]
    high[at] = r.high[at + 1]
    keep = ~closes
    where = np.flatnonzero(opens[keep])
    return Round(name[keep], low[keep], high[keep], r.text[keep], r.first, r.at[keep], (where, PAIR, r.name[at], r.name[at + 1]))


def named_rounds(name: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> list[tuple[Round, Round]]:
    """Each round's symbols after its runs and after its pairs are named."""
    r, out = first_round(name, first), []
    for k in range(rounds):
        one = runs(r)
        r = pairs(one, k)
        out.append((one, r))
    return out


def prefix_sums(name: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    sums = np.zeros(len(name) + 1, np.uint64)
    np.cumsum(name * W.powers(base, len(name)), out=sums[1:])
    return sums, W.powers(inverse, len(name) + 1)


def span_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, down = sums
    return W.mix((total[end] - total[start]) * down[start])


def window_starts(first: np.ndarray, window: int) -> np.ndarray:
    """For each word, whether a window of one text starts there."""
    n = int(first[-1]) if len(first) else 0
    out = np.zeros(n + 1, np.int32)
    many = np.maximum(np.diff(first) - window + 1, 0)
    has = many > 0
    np.add.at(out, first[:-1][has], 1)
    np.add.at(out, first[:-1][has] + many[has], -1)
    return np.cumsum(out[:-1]) > 0


def _range_min(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of value[start:end], for ranges that are not empty."""
    size = end - start
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(start), value.dtype)
    table = value
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        own = level == k
        out[own] = np.minimum(table[start[own]], table[end[own] - (1 << k)])
    return out


def anchors(name: np.ndarray, first: np.ndarray, window: int, rounds: int = ROUNDS) -> np.ndarray:
    """For each word where a window starts the key of the window's anchor; 0 elsewhere.

    The key of a symbol hashes its name and the words that settle it.  A window takes the least
    key among its settled symbols of the highest round that has any in it, which is the same
    choice wherever the window's words recur, and few different ones along a text.  A window
    without a settled symbol (such as one of a single repeated word) has the hash of all its
    words as key.
    """
    key = np.zeros(len(name), np.uint64)
    todo = window_starts(first, window)
    if not todo.any():
        return key
    sums = prefix_sums(name, _UP2)
    levels = [pair for _, pair in named_rounds(name, first, rounds)]
    starts = np.flatnonzero(todo)
    for k in range(rounds - 1, -1, -1):
        r = levels[k]
        start = np.searchsorted(r.low, starts, "left")
        end = np.searchsorted(r.high, starts + window, "right")
        has = end > start
        if has.any():
            inner = (r.low >= 0) & (r.high <= len(name))
            made = np.zeros(len(r.name), np.uint64)
            made[inner] = span_hash(sums, r.low[inner], r.high[inner]) ^ W.mix(r.name[inner] + np.uint64(k + 1))
            key[starts[has]] = _range_min(made, start[has], end[has]) | np.uint64(1)
            starts = starts[~has]
        if not len(starts):
            return key
    key[starts] = span_hash(sums, starts, starts + window) | np.uint64(1)
    return key


def _gather(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(place in the values, passage) of each symbol, from ranges ``passage, order, start, end``."""
    owner, order, start, end = (np.concatenate(x) for x in zip(*parts))
    has = end > start
    owner, order, start, end = owner[has], order[has], start[has], end[has]
    turn = np.lexsort((order, owner))
    owner, start, size = owner[turn], start[turn], (end - start)[turn]
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(before - start, size), np.repeat(owner, size)


def spell(name: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, rounds: list[tuple[Round, Round]]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, passage of each): the passages of words [start, end) written with few symbols.

    A passage is the settled symbols of its highest round that has any, and on both sides, round
    by round down to the words, those that reach further.  Only words of the passage bear on the
    choice, so equal passages have equal symbols wherever they stand; if no name has two meanings,
    passages with equal symbols have equal words.
    """
    levels = [first_round(name, first), *(pair for _, pair in rounds)]
    offset = np.cumsum([0] + [len(r.name) for r in levels])
    passage, parts = np.arange(len(start)), []
    low, high = np.full(len(start), -1, np.int64), np.full(len(start), -1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        r = levels[k]
        a, b = np.searchsorted(r.low, start, "left"), np.searchsorted(r.high, end, "right")
        has, begun = b > a, low >= 0
        new, more = has & ~begun, has & begun
        left, right = np.searchsorted(r.at, low), np.searchsorted(r.at, high)
        for own, order, x, y in ((new, 0, a, b), (more, k - len(levels), a, left), (more, len(levels) - k, right, b)):
            if own.any():
                parts.append((passage[own], np.full(int(own.sum()), order), x[own] + offset[k], y[own] + offset[k]))
        after = np.append(r.at, len(name))
        low[has], high[has] = r.at[a[has]], after[b[has]]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place, owner = _gather(parts)
    return np.concatenate([r.name for r in levels])[place], owner


def within(low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the ranges [low, high) lie inside one of the passages [start, end)."""
    turn = np.argsort(start, kind="stable")
    furthest = np.maximum.accumulate(end[turn])
    k = np.searchsorted(start[turn], low, "right") - 1
    return (k >= 0) & (furthest[np.maximum(k, 0)] >= high)
