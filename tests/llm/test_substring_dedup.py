import hashlib
import random
import re

import numpy as np

from quillspark.llm import recompression, substring_dedup as S, words


def brute(rows, window):
    split = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
    owner = {}
    for d, x in split:
        for i in range(len(x) - window + 1 if d is not None else 0):
            key = tuple(x[i : i + window])
            owner[key] = min(owner.get(key, d), d)
    out = []
    for d, x in split:
        gone = [False] * len(x)
        for i in range(len(x) - window + 1 if d is not None else 0):
            if owner[tuple(x[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_digest_of_odd_rows(odd, odd_rows, as_rows):
    got = as_rows(S.digest(odd))
    assert got == brute(odd_rows, 50)
    assert any(r[2] for r in got)


def test_digest_of_documents(spark, sf, as_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert as_rows(S.digest(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_dedup_keeps_columns_and_untouched_texts(odd, odd_rows):
    out = S.dedup(odd)
    assert out.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.count() == len(odd_rows) and texts[2] == "" and texts[1] == odd_rows[0][1] and texts[5] == " \t\n" and texts[3] is None


def test_empty_table(empty):
    assert S.digest(empty).collect() == [] and S.dedup(empty).collect() == []


def test_equal_windows_have_equal_keys():
    rng = random.Random(3)
    for _ in range(60):
        alphabet = [b"%d" % k for k in range(rng.choice([1, 2, 3, 30]))]
        texts = [[rng.choice(alphabet) for _ in range(rng.randrange(0, 90))] for _ in range(4)]
        for _ in range(3):
            a, b = rng.choice(texts), rng.choice(texts)
            at = rng.randrange(0, max(1, len(a)))
            b[rng.randrange(0, len(b) + 1) : 0] = a[at : at + 30]
        joined = [b" ".join(t) for t in texts]
        data = np.frombuffer(b"".join(joined), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(j) for j in joined])])
        starts, ends, first = words.spans(data, offsets)
        assert first[-1] == sum(map(len, texts))
        key = recompression.anchors(words.names(data, starts, ends), first, 12)
        seen = {}
        for t, x in enumerate(texts):
            for i in range(len(x) - 11):
                assert key[first[t] + i] != 0
                assert seen.setdefault(tuple(x[i : i + 12]), key[first[t] + i]) == key[first[t] + i]


def thue_morse(n, flip):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out.translate(str.maketrans("ab", "ba")) if flip else out


def test_long_words_that_polynomials_confuse(spark, as_rows):
    rows = []
    for k, n in enumerate((256, 1024, 2048, 4096)):
        first, second = thue_morse(n, False), thue_morse(n, True)
        shared, tail = " ".join(f"w{n}.{i}" for i in range(49)), " ".join(f"q{n}.{i}" for i in range(29))
        rows += [(10 * k + 1, f"{first} {shared} end"), (10 * k + 2, f"{second} {shared} {tail}")]
    got = as_rows(S.digest(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute(rows, 50) and not any(r[2] for r in got)


def arrays(texts):
    joined = [b" ".join(t) for t in texts]
    data = np.frombuffer(b"".join(joined), np.uint8)
    return data, *words.spans(data, np.concatenate([[0], np.cumsum([len(j) for j in joined])]))


def test_passages_are_spelt_alike_where_their_words_are():
    rng = random.Random(5)
    for _ in range(40):
        alphabet = [b"%d" % k for k in range(rng.choice([1, 2, 4, 40]))]
        part = [rng.choice(alphabet) for _ in range(rng.randrange(1, 200))]
        texts = [[rng.choice(alphabet) for _ in range(rng.randrange(0, 30))] + part + [rng.choice(alphabet) for _ in range(rng.randrange(0, 30))] for _ in range(3)]
        data, starts, ends, first = arrays(texts)
        name = words.names(data, starts, ends)
        begin = np.array([next(i for i in range(len(t)) if t[i : i + len(part)] == part) for t in texts]) + first[:-1]
        symbols, own = recompression.spell(name, first, begin, begin + len(part), recompression.named_rounds(name, first))
        spelt = [symbols[own == k].tolist() for k in range(3)]
        assert spelt[0] == spelt[1] == spelt[2] and len(spelt[0]) <= len(part)
        change = begin.copy()
        change[1] += 1
        if len(set(part)) > 1 and texts[1][change[1] - first[1] : change[1] - first[1] + len(part)] != part and change[1] + len(part) <= first[2]:
            symbols, own = recompression.spell(name, first, change, change + len(part), recompression.named_rounds(name, first))
            assert symbols[own == 0].tolist() != symbols[own == 1].tolist()


def test_a_name_with_two_meanings_is_told(monkeypatch):
    real = words.names
    monkeypatch.setattr(S.W, "names", lambda *a: real(*a) % np.uint64(7))
    data, starts, ends, first = arrays([[b"w%d" % k for k in range(60)]])
    rows = [b.to_pylist() for b in S._spelt(data, starts, ends, first, np.array([0]), np.array([60]), [np.array([1])] * 3 + [np.array([60], np.int32)], 0, [np.zeros(0, np.uint64)] * 3)]
    assert [r["kind"] for r in rows[0]] == ["passage"]
    assert len({r["name"] for r in rows[1] if r["kind"] == "word"}) == 7  # one of each name here; other texts tell other words
    data, starts, ends, first = arrays([[b"v%d" % k for k in range(60)]])
    more = [r for b in S._spelt(data, starts, ends, first, np.array([0]), np.array([60]), [np.array([1])] * 3 + [np.array([60], np.int32)], 0, [np.zeros(0, np.uint64)] * 3) for r in b.to_pylist()]
    both = {}
    for r in [x for b in rows for x in b] + more:
        if r["kind"] == "word":
            both.setdefault(r["name"], set()).add(r["word"])
    assert any(len(v) > 1 for v in both.values())


def test_a_collision_starts_the_search_again(odd, monkeypatch, as_rows, odd_rows):
    seeds, real = [], S._collided
    monkeypatch.setattr(S, "_collided", lambda lost, suspects, window, seed: seeds.append(seed) or real(lost, suspects, window, seed) or seed == 0)
    assert as_rows(S.digest(odd)) == brute(odd_rows, 50) and seeds == [0, 1]


def test_clashing_columns_stay(odd):
    from pyspark.sql import functions as F

    wide = odd.withColumn("cut_id", F.lit(1)).withColumn("CUT_TEXT", F.lit("x")).withColumn("owner", F.lit(7)).withColumn("__kept", F.lit("k"))
    out = S.dedup(wide)
    assert out.columns == wide.columns and {(r["cut_id"], r["CUT_TEXT"], r["owner"], r["__kept"]) for r in out.collect()} == {(1, "x", 7, "k")}
