import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from quillspark.functions import similarity
from quillspark.operators import alike


def plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def strings(n, rng, letters="abcdeé日", most=150):
    out = ["".join(rng.choices(letters, k=rng.randrange(most))) for _ in range(n // 2)]
    for s in list(out):
        t = list(s)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t) + 1) if t else 0 : 0] = rng.choice(letters)
            if t and rng.random() < 0.7:
                del t[rng.randrange(len(t))]
        out.append("".join(t))
    return out


def test_longest_common_subsequences():
    rng = random.Random(4)
    a, b = strings(200, rng, most=300), strings(200, rng, most=300)
    a[:4], b[:4] = ["", "a" * 1500, "ab" * 700, "abc"], ["b", "b" * 1500 + "a" * 3, "ba" * 800, ""]
    assert similarity.common(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]
    assert similarity.common([], []).tolist() == []


@pytest.mark.parametrize("t", [0.3, 0.75, 0.92, 1.0])
def test_ratios_at_a_threshold(t):
    rng = random.Random(5)
    a = strings(120, rng)
    b = [*a[60:], *a[:60]]
    want = [SequenceMatcher(None, x, y).ratio() if x or y else None for x, y in zip(a, b)]
    assert similarity.ratios([*a, None], [*b, "x"], t) == [r if r is not None and r >= t else None for r in want] + [None]


@pytest.mark.parametrize("t", [0.6, 0.7, 0.75, 0.9, 0.92, 0.99])
def test_pairs_against_all_pairs(spark, t):
    rng = random.Random(6)
    texts = strings(160, rng, most=60) + ["", "a", "b", "ab", "ba", None, "a"]
    key = lambda: rng.choice(["k", "k", "m", None])
    left, right = [(key(), x) for x in texts], [(key(), y) for y in reversed(texts)]
    make = lambda rows: spark.createDataFrame(rows, "venue string, text string").repartition(3)
    want = set()
    for k, x in set(left):
        for m, y in set(right):
            if k == m and k and x and y and (score := SequenceMatcher(None, x, y).ratio()) >= t:
                want.add((k, x, y, score))
    got = [tuple(r) for r in alike.pairs(make(left), make(right), ["venue"], t).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_few_pairs_are_compared(spark):
    """A fixture of words: what meets is told, and is a small part of all pairs."""
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshrdlu", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3], k=rng.randrange(2, 9))) for _ in range(400)]
    titles = [" ".join(rng.choices(words, k=rng.randrange(5, 12))) for _ in range(400)]
    left = spark.createDataFrame([("v", t) for t in titles], "venue string, text string")
    right = spark.createDataFrame([("v", t[:-1] + "x") for t in titles], "venue string, text string")
    met = [(r.left, r.right) for r in alike.candidates(left, right, ["venue"], 0.9).collect()]
    slow = sum(2 * similarity.common(*map(list, zip(*met))) >= 0.9 * np.array([len(x) + len(y) for x, y in met]) - 1e-9)
    found = alike.pairs(left, right, ["venue"], 0.9).count()
    assert 400 <= found <= slow < 2 * found and len(met) < 400 * 400 / 4


def test_lengths_that_share_runs():
    assert alike.short_of(0.6, 2) is None and alike.short_of(0.5, 1) == 1
    for t in (0.7, 0.75, 0.9, 0.92):
        n = alike.short_of(t, 2)
        low = lambda s: math.ceil(s * (1.5 * t - 1) - 1 - 1e-9)
        exact = lambda s: 3 * math.ceil(s * t / 2 - 1e-9) - s - 1
        assert low(2 * n) >= 1 and all(exact(s) >= low(2 * n) for s in range(2 * n, 2000)) and (n == 1 or low(2 * n - 2) < 1)
