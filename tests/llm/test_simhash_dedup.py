import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import components, simhash_dedup as S


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    rows = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(r, seed=42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(rows, bits=3):
    """rows: (id, fingerprint); the least id that each can reach."""
    fps = np.array([f for _, f in rows], np.uint64)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if np.bitwise_count(fps[i] ^ fps[j]) <= bits or rows[i][0] == rows[j][0]:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(rows))]


def test_digest_of_odd_rows(odd, odd_rows, as_rows):
    named = [(d, plain_fingerprint(t)) for d, t in odd_rows if d is not None]
    want = [(d, f"{f:016x}", r) for (d, f), r in zip(named, roots(named))]
    want += [(d, f"{plain_fingerprint(t):016x}", None) for d, t in odd_rows if d is None]
    assert as_rows(S.digest(odd)) == sorted(want, key=repr)


def test_dedup(odd):
    out = S.dedup(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert 2 not in ids and 4 not in ids and 16 not in ids and {1, 3, 13, 15, None} <= set(ids)


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = [int(c) for c in centre]
    for _ in range(600):  # a dense group, dealt into parts, and pairs at each distance
        fps.append(fps[0] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    for c in centre[1:]:
        fps.append(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = list(dict.fromkeys(fps))
    rows = [(k, f) for k, f in enumerate(fps)]
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in rows], "fp bigint, node bigint")
    found = dict(tuple(r) for r in components.components(S.link(nodes, 3, 50)).collect())
    assert [found.get(k, k) for k, _ in rows] == roots(rows)


def test_bound_is_below_the_distance():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 63, 2000, np.uint64), rng.integers(0, 1 << 63, 2000, np.uint64)
    y[:1000] = x[:1000] ^ (np.uint64(1) << rng.integers(0, 63, 1000).astype(np.uint64))
    near = S.manhattan(S.embed(x), S.embed(y))
    assert (near <= np.bitwise_count(x ^ y)).all() and (near >= 0).all() and near.max() > 3


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201)], "u bigint, v bigint")
    got = dict(tuple(r) for r in components.components(edges).collect())
    assert got == {**{k: 0 for k in range(1, 101)}, 201: 200}


def test_long_text_is_taken_in_chunks(monkeypatch):
    text = " ".join(str(k % 977) for k in range(5000)).encode()
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "CHUNK", 64)
    assert S.fingerprint(text) == whole == plain_fingerprint(text.decode())


def test_empty_table(empty):
    assert S.digest(empty).collect() == []
    assert S.dedup(empty.withColumn("x", F.lit(1))).collect() == []
