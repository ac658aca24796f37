import random

import numpy as np

import corpus_pipeline
from quillspark.llm import near_copies as N


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def kept(rows):
    """Ids that reach no smaller id; every pair is compared by its exact Jaccard similarity."""
    named = [(d, shingles(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in named}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(named):
        for e, b in named[:i]:
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                low, high = sorted((top(d), top(e)))
                up[high] = low
    return sorted({top(d) for d in up})


def changed(rng, words, many):
    """A copy with other words at so many places, which changes up to five shingles each."""
    out = list(words)
    for k in rng.sample(range(len(out)), many):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def corpus():
    """Copies with 0 to 8 changed words around 0.8, a dense group and a line that most texts share."""
    rng = random.Random(7)
    line = "this line stands in most of the texts and is no sign of a copy at all".split()
    rows = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 90, 200)))]
        base = base + line if rng.random() < 0.8 else base
        rows += [changed(rng, base, rng.randrange(0, 9)) for _ in range(rng.randrange(1, 4))]
        rows.append(base[: int(len(base) * rng.uniform(0.7, 1))])
    dense = [f"d{rng.randrange(5000)}" for _ in range(150)]
    rows += [changed(rng, dense, rng.randrange(1, 5)) for _ in range(80)]
    rng.shuffle(rows)
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


def test_stage_against_all_pairs(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = kept(rows)
    assert len(rows) - len(want) > 60
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").select("doc_id").collect()]
    assert sorted(got) == want
    monkeypatch.setattr(N, "SAMPLE", 1)  # a set of common hashes moves the order, not the result
    monkeypatch.setattr(N, "SEEN", 3)
    assert sorted(r["doc_id"] for r in N.dedup(df).select("doc_id").collect()) == want


def test_odd_rows(odd, odd_rows):
    out = N.dedup(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted({d for d in ids if d is not None}) == kept(odd_rows) and ids.count(None) == 1


def test_empty_table(empty):
    assert N.dedup(empty).collect() == []


def test_fingerprints_meet_on_the_grid(spark):
    rows = corpus()
    firsts = N.firsts(spark.createDataFrame(rows, "doc_id bigint, text string"), np.zeros(0, np.int64)).select("doc_id", "fp").collect()
    prints = {r["doc_id"]: r["fp"] for r in firsts}
    found = N.by_bits(spark.createDataFrame([(fp, d) for d, fp in prints.items()], "fp bigint, node bigint"))
    up = {d: d for d in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in found.collect():
        assert ((prints[u] ^ prints[v]) & (1 << 64) - 1).bit_count() <= 3
        up[top(v)] = top(u)
    close = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 3]
    assert close and all(top(a) == top(b) for a, b in close)
