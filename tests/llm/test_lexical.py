import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import catalogue, lexical as L, scratch

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(docs, items, k=10):
    parsed = [(d, Counter(split(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in parsed]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in parsed for t in c)
    own = {}
    for i, t in items:
        if i is not None:
            own.setdefault(i, set()).update(split(t))
    out = []
    for i, terms in own.items():
        scores = []
        for (d, c), size in zip(parsed, sizes):
            m = 100 - 90 + 90 * size * n // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    some = ["alpha", "Beta", "GAMMA", "é", "İx", "x1", "日本", "a", "rare"] + [f"w{n}" for n in range(60)]
    text = lambda n: " ".join(rng.choices(some, [40, 30, 20, 10, 5, 5, 5, 60, 0.2] + [3] * 60, k=n))
    docs = [(n, text(rng.randrange(1, 60))) for n in range(300)] + [(300 + n, "alpha beta rare") for n in range(50)]
    docs += [(400, None), (401, ""), (402, "_-;\x00"), (403, text(20000)), (5, "alpha beta rare"), (None, "rare rare"), (None, "rare rare"), (404, "a-b_c\x7fd日本e"), (404, "a-b_c\x7fd日本e")]
    items = [(n, text(rng.randrange(1, 12))) for n in range(20)] + [(20, None), (21, ""), (22, "rare"), (22, "w5 W5"), (23, "nowhere"), (None, "alpha"), (24, "x" * 400 + " rare"), (22, "rare")]
    return docs, items


@pytest.mark.parametrize("block, slice_terms, seeds", [(64, 200_000, 4), (3, 20, 1), (1, 200_000, 2), (1000, 200_000, 1)])
def test_search_against_brute_force(spark, as_rows, rows, block, slice_terms, seeds):
    docs, items = rows
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"block": F.lit(1), "score": F.lit("x"), "item_id": F.lit(3)}).repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumns({"term": F.lit(1), "doc_id": F.lit(2)})
    assert as_rows(L.search(d, i, block=block, slice_terms=slice_terms, seeds=seeds)) == brute(docs, items)


def test_empty_tables(spark, as_rows, rows):
    docs, items = rows
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert as_rows(L.search(d.limit(0), i)) == as_rows(L.search(d, i.limit(0))) == as_rows(L.search(d.where("text = ''"), i)) == []
    assert L.search(d.limit(0), i).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_keep_to_their_text():
    texts = ["ab", "cd e", "", "É-f", "g"]
    data = [t.encode() for t in texts]
    found, first = L.terms(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert [x.decode() for x in found.to_pylist()] == ["ab", "cd", "e", "É", "f", "g"] and first.tolist() == [0, 1, 3, 3, 5, 6]


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    docs = [(n, f"common w{n % 50} " * (1 + n % 3)) for n in range(640)] + [(1000 + n, "needle needle common") for n in range(10)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    plain = scratch.save(L.index(df, [b"common", b"needle"], 10), "t")
    counts = L.corpus(plain, 2)
    blocks = scratch.save(L.maxima(plain, counts), "t")
    items = [(7, np.array([0, 1]))]
    seed = [r.block for r in L.best_blocks(blocks, items, counts, 1).collect()]
    (least,) = [(r["score"], r["doc"]) for r in L.first(L.scored(blocks.where(F.col("block").isin(seed)), items, counts, {})).where("rank = 10").collect()]
    assert least[1] == 1009
    batch = pa.RecordBatch.from_pandas(blocks.toPandas())
    weight = counts.weight
    assert sum(b >= least[0] for b in L.bounds(batch)(weight)) == 1 < len(batch)


def test_query_against_brute_force(spark, sf, as_rows):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = as_rows(catalogue.queries()["op12_lexical_search"](spark, sf))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
