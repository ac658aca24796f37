"""Compatibility decomposition (NFKD) as column expressions.

A text is taken apart into code points; each is looked up by its number in one array, in constant time,
Hangul syllables are taken apart by arithmetic, and runs of marks are put into their canonical order.
Texts that need none of it pass as they are.  The tables are built from Python's Unicode data.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = 256  # code points without an entry that a span of the table may hold
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7  # Fixed values: where Hangul begins
COUNT, PER_LEAD, PER_VOWEL = 11172, 588, 28


def _points() -> Iterable[int]:
    return (p for p in range(0xA0, 0x110000) if not 0xD800 <= p < 0xE000)


@cache
def spans() -> tuple[tuple[tuple[int, int, int], ...], str]:
    """((first, last, place of the first) of each span; the decompositions, an empty one for none, by NUL)."""
    found = [p for p in _points() if not SYLLABLES <= p < SYLLABLES + COUNT and unicodedata.normalize("NFKD", chr(p)) != chr(p)]
    out: list[list[int]] = []
    for p in found:
        if out and p - out[-1][1] <= GAP:
            out[-1][1] = p
        else:
            out.append([p, p])
    at, places, texts = 0, [], []
    for first, last in out:
        places.append((first, last, at))
        texts += [d if (d := unicodedata.normalize("NFKD", chr(p))) != chr(p) else "" for p in range(first, last + 1)]
        at += last - first + 1
    return tuple(places), "\0".join(texts)


def char_class(points: Iterable[int]) -> str:
    """The inside of a character class, as ranges."""
    out: list[list[int]] = []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


@cache
def _marks() -> str:
    return char_class(p for p in _points() if unicodedata.combining(chr(p)))


@cache
def _classes() -> str:
    """Each mark and the character whose number is its combining class, in turn."""
    return "".join(chr(p) + chr(unicodedata.combining(chr(p))) for p in _points() if unicodedata.combining(chr(p)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed, and kept in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decomposed(c: Column) -> Column:
    code = F.ascii(c)
    places, texts = spans()
    place = F.lit(None).cast("int")
    for first, last, at in places:
        place = F.when((code >= first) & (code <= last), code - first + at).otherwise(place)
    table = F.split(F.lit(texts), "\0", -1)
    n = code - SYLLABLES
    lead, vowel, tail = (n / PER_LEAD).cast("int"), (n % PER_LEAD / PER_VOWEL).cast("int"), n % PER_VOWEL
    # from_code is a decoding of UTF-16, as Spark has no such function beyond one byte
    char = lambda base, k: F.decode(F.unhex(F.lpad(F.hex(k + base), 4, "0")), "UTF-16BE")
    syllable = F.concat(char(LEADS, lead), char(VOWELS, vowel), F.when(tail > 0, char(TAILS, tail)).otherwise(""))
    return F.when(code < 0xA0, c).when((n >= 0) & (n < COUNT), syllable).otherwise(let(F.get(table, place), lambda d: F.when(d != "", d).otherwise(c)))


def _ordered(x: Column) -> Column:
    """Runs of marks in the order of their combining classes, equal ones as they were."""
    marks = _marks()
    pairs = _classes()
    source, target = pairs[::2], "".join(chr(0x4E00 + ord(c)) for c in pairs[1::2])  # one letter a class, in order
    piece = lambda s: F.array_join(F.transform(F.array_sort(F.transform(F.split(s, ""), lambda c, i: F.struct(F.when(c.rlike(f"^[{marks}]$"), F.ascii(F.translate(c, source, target))).otherwise(0).alias("k"), i.alias("i"), c.alias("c")))), lambda e: e["c"]), "")
    parts = F.regexp_extract_all(x, F.lit(rf"(?s)[^{marks}]?[{marks}]+|[^{marks}]+"), F.lit(0))
    one = lambda s: F.when(s.rlike(f"[{marks}]{{2}}"), F.concat(F.regexp_extract(s, f"(?s)^[^{marks}]*", 0), piece(F.regexp_extract(s, f"[{marks}]+$", 0)))).otherwise(s)
    return F.when(x.rlike(f"[{marks}]{{2}}"), F.array_join(F.transform(parts, one), "")).otherwise(x)


def nfkd(x: Column | str) -> Column:
    """A text's compatibility decomposition; null stays null."""
    x = F.col(x) if isinstance(x, str) else x
    apart = F.array_join(F.transform(F.split(x, ""), _decomposed), "")
    return F.when(x.rlike(r"[^\x00-\x9f]"), let(apart, _ordered)).otherwise(x)


def unmarked(x: Column | str) -> Column:
    """``nfkd`` without its marks."""
    return F.regexp_replace(nfkd(x), f"[{_marks()}]+", "")
