import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import catalogue, packing as P, word_tokens

PATH = catalogue.vocabulary("word_bpe_49k.json")


def least_rows(items, size):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rows):
        if len(rows) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rows)
            return
        tried = set()
        for j in range(len(rows)):
            if rows[j] + items[k] <= size and rows[j] not in tried:
                tried.add(rows[j])
                rows[j] += items[k]
                go(k + 1, rows)
                rows[j] -= items[k]
        rows.append(items[k])
        go(k + 1, rows)
        rows.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_a_best_packing():
    rng = random.Random(4)
    for _ in range(200):
        size = rng.choice([10, 20, 31])
        items = [rng.randint(1, size) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(items, minlength=size + 1)
        fixed, left = P.reduce(counts)
        rest = [n for n in range(size + 1) for _ in range(left[n])]
        assert sum(m for m, _ in fixed) + least_rows(rest, size) == least_rows(items, size)
        rows = P.plan(counts)
        used = np.zeros(size + 1, int)
        for many, pattern in rows:
            assert sum(n * k for n, k in pattern) <= size
            for n, k in pattern:
                used[n] += many * k
        assert (used == counts).all()


def test_large_counts_stay_close_to_the_bound():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.clip(rng.lognormal(6, 1, 200_000).astype(int), 1, 2048), minlength=2049) * 1000
    rows = P.plan(counts)
    bound = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert bound <= sum(m for m, _ in rows) <= bound * 1.001 and len(rows) < 3 * 2048


def check(rows, texts, size):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), size)):
            part = np.array(ids[a : a + size], "<u4").tobytes()
            want.append((d, k, a, len(part) // 4, zlib.crc32(part)))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("size", [2048, 100])
def test_odd_rows(odd, odd_rows, size):
    rows = P.pack(odd, PATH, size).collect()
    n = check(rows, odd_rows, size)
    assert n <= 1.05 * -(-sum(r["length"] for r in rows) // size) + 1


def test_documents_in_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = P.scratch.save(P.pieces(docs, PATH), "pieces")
    rows = P.place(pieces, bucket=7).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)


def test_ids_and_empty_table(odd, empty):
    row = P.pack(odd.where("doc_id = 13"), PATH, with_ids=True).first()
    assert np.frombuffer(row["ids"], "<u4")[-1] == 0 and zlib.crc32(row["ids"]) == row["ids_crc32"]
    assert P.pack(empty, PATH).collect() == []


def test_word_cache_gives_the_same_ids():
    t, whole = word_tokens.WordTokenizer(PATH, 5), Tokenizer.from_file(PATH)
    texts = ["It's 2024's  Ábc é̀", "a\x0bb\x1cc d", "ΑΣ ΣΑΣ İI", "x" * 3000 + " y", "́ ̧", "<|endoftext|>a <|startoftext|>"] * 2
    for x in texts:
        assert np.frombuffer(t.encode([x.encode()])[0], "<u4").tolist() == whole.encode(x, add_special_tokens=False).ids
