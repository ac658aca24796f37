import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from quillspark.functions import similarity
from quillspark.operators import alike, match


def titles(rng, n, most):
    """Prose of few letters, and copies of it with changes here and there."""
    words = ["".join(rng.choices("etaoinshrdluqzé", k=rng.randrange(2, 9))) for _ in range(300)]
    out = [" ".join(rng.choices(words, k=rng.randrange(1, most))) for _ in range(n // 4)]
    for _ in range(n - len(out)):
        t = list(rng.choice(out[: n // 4]))
        for _ in range(rng.randrange(1 + len(t) // 12)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = rng.choices("etaoinqz ", k=rng.randrange(3))
        out.append("".join(t).strip() or "x")
    return out


@pytest.mark.parametrize("small", [False, True])
def test_best_against_all_pairs(spark, monkeypatch, small):
    if small:
        for name in ("LEFTS", "RIGHTS", "HITS", "BLOCK", "PART"):
            monkeypatch.setattr(alike, name, 7)
    rng = random.Random(8)
    left, right = ([(rng.choice("ab"), k, t) for k, t in enumerate(titles(rng, 120, 80))] for _ in range(2))
    right += [(v, 1000 + i, t[: len(t) // 30] + t[len(t) // 30 + 1 :]) for v, i, t in left] + [(v, 2000 + i, t + "q") for v, i, t in left[::3]] + [(v, 3000 + i, t) for v, i, t in left[::9]]
    want = {}
    for v, i, x in left:
        for w, j, y in right:
            if v == w and x and y and 2 * len(y) > len(x) and (score := SequenceMatcher(None, x, y).ratio()) >= 0.9:
                want[i] = max(want.get(i, (0, 0, "")), (score, j, y))
    make = lambda rows: spark.createDataFrame(rows, "venue string, id bigint, title string").repartition(3)
    if small:  # workers read the module anew, so the function runs here
        table = lambda d, s: d.selectExpr("venue", "title AS text").distinct().selectExpr("venue", "text", f"{s}L AS side", "CAST(length(text) AS BIGINT) AS n", "xxhash64(venue) AS cell")
        rows = table(make(left), 0).union(table(make(right), 1)).orderBy("cell").toArrow().to_batches(50)
        got = {}
        for batch in alike._met(0.9, ["venue"], True, True)(iter(rows)):
            for r in batch.to_pylist():
                got[r["venue"], r["left"]] = max(got.get((r["venue"], r["left"]), 0), r["score"])
        near = {(v, x): s for v, i, x in left if (s := want.get(i, (0,))[0]) and s < 1}
        assert near and {k: got.get(k) for k in near} == near
        return
    got = {r.left_id: (r.score, r.right_id, r.right_title) for r in match.fuzzy_best(make(left), make(right), ["venue"], 0.9).collect()}
    assert got == want and sum(len(left[i][2]) >= 220 for i in want) > 10 and sum(0.9 <= s < 1 for s, *_ in want.values()) > 50


def test_pairs_of_long_prose_are_not_all_compared(monkeypatch):
    """Strings of other prose of equal length meet no counts of pieces and no common subsequences."""
    import pyarrow as pa

    rng = random.Random(9)
    words = ["".join(rng.choices("etaoinshrdlu", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3], k=rng.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=100))[:400] for _ in range(400)]
    seen = {"pieces": 0, "common": 0}
    counts, common = alike._counts, similarity.common
    monkeypatch.setattr(alike, "_counts", lambda flat, n, q, bins: (seen.__setitem__("pieces", seen["pieces"] + len(n) * (q > 1)), counts(flat, n, q, bins))[1])
    monkeypatch.setattr(similarity, "common", lambda a, b: (seen.__setitem__("common", seen["common"] + len(a)), common(a, b))[1])
    both = texts[:200] + [t[:-1] + "x" for t in texts[:20]] + texts[200:]
    rows = pa.table({"venue": ["v"] * 420, "text": both, "side": [0] * 200 + [1] * 220, "n": np.array([len(t) for t in both]), "cell": [7] * 420})
    found = [r for b in alike._met(0.9, ["venue"], True, True)(iter(rows.to_batches())) for r in b.to_pylist()]
    assert [(r["left"], r["right"]) for r in found] == [(t, t[:-1] + "x") for t in texts[:20]]
    assert seen["pieces"] < 200 and seen["common"] < 60


def test_near_copies_are_rated_once_or_little_more(monkeypatch):
    import pyarrow as pa

    rng = random.Random(10)
    head = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=150))
    texts = []
    for _ in range(100):
        t = list(head)
        for k in rng.sample(range(150), 5):
            t[k] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        texts.append("".join(t))
    texts = sorted(set(texts), key=texts.index)
    left = texts[:50]
    right = texts[50:] + [t[:70] + t[71:] for t in left]
    many = {"n": 0}
    common = similarity.common
    monkeypatch.setattr(similarity, "common", lambda a, b: (many.__setitem__("n", many["n"] + len(a)), common(a, b))[1])
    both = left + right
    rows = pa.table({"venue": ["v"] * len(both), "text": both, "side": [0] * len(left) + [1] * len(right), "n": np.array([len(t) for t in both]), "cell": [7] * len(both)})
    found = {r["left"]: r["score"] for b in alike._met(0.9, ["venue"], True, True)(iter(rows.to_batches())) for r in b.to_pylist()}
    assert found == {t: max(SequenceMatcher(None, t, y).ratio() for y in right) for t in left}
    assert many["n"] < len(left) * len(right) / 5


def test_ratios_are_those_of_difflib():
    rng = random.Random(11)
    texts = titles(rng, 24, 90) + ["ab" * 200, "z" + "ab" * 150 + "q", "x" * 300, "", "q" * 3 + "x" * 300]
    texts += [t[: len(t) // 2] + rng.choice("qz0") + t[len(t) // 2 :] for t in texts] + ["".join(rng.sample([chr(300 + k) for k in range(260)], 250)) for _ in range(3)]
    for a in texts:
        for b in texts:
            score = SequenceMatcher(None, a, b).ratio()
            assert similarity.ratio_of(a, b, 0.0) == score
            for least in (score, 0.5, 0.9, np.nextafter(score, 2)):
                assert similarity.ratio_of(a, b, least) == (score if score >= least else None)
