"""Top-k search, token counts, pieces, WARC audit, the pipeline and the catalogue."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import catalogue, piece_fst, token_counts as K, topk, warc_audit as M
from test_near_copies import kept
from test_substring_dedup import brute

PIECES, RANKS = catalogue.vocabulary("piece_bpe_32k.model"), catalogue.vocabulary("byte_bpe_50k.tiktoken")


def plain_topk(rows, wanted, k=10):
    out = []
    for q, v in rows:
        if not wanted(q):
            continue
        best = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_with_ties_copies_and_bad_vectors(spark, as_rows):
    rng = np.random.default_rng(0)
    good = [(k, rng.standard_normal(8).round(2).tolist()) for k in range(300)]
    good += [(k, [0.5] * 8) for k in range(300, 420)] + [(k, [0.0] * 8) for k in range(420, 440)]
    bad = [(500, None), (600, [float("nan")] + [0.0] * 7), (700, [float("inf")] * 8), (800, [None] + [1.0] * 7), (900, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<float>").withColumn("d", F.lit(1)).repartition(3)
    exact = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in good]
    got = as_rows(topk.search(df, "vec_id", "embedding", F.col("id") % 20 == 0, pivots=4, block=16))
    assert sorted(got) == plain_topk(exact, lambda i: i % 20 == 0)


def test_topk_of_few_and_no_rows(spark, as_rows):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert as_rows(topk.search(df, "vec_id", "embedding", F.col("id") == 0)) == [(0, 1, 1, 1024 * 2048)]
    assert topk.search(df.limit(0), "vec_id", "embedding", F.col("id") == 0).collect() == []


def test_topk_of_each_length_and_of_large_components(spark, as_rows):
    rng = np.random.default_rng(1)
    rows = [(100, [1.0, 2.0]), (101, [1e7, 0.5]), (102, [3.0] * 3), (200, [1.0] * 3), (300, [9.0] * 5), (400, [1e18, -1e18]), (500, [1e300, 1.0])]
    rows += [(1000 + k, (rng.standard_normal(4) * 10.0 ** rng.integers(0, 9)).tolist()) for k in range(120)]
    exact = [(i, [min(max(int(np.floor(1024 * x)), -(1 << 63)), (1 << 63) - 1) for x in v]) for i, v in rows]
    want = []
    for q, v in exact:
        if q % 100 == 0:
            score = lambda w: min(max(sum(a * b for a, b in zip(v, w)), -(1 << 63)), (1 << 63) - 1)
            best = sorted((-score(w), i) for i, w in exact if i != q and len(w) == len(v))[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(as_rows(topk.search(df, "vec_id", "embedding", F.col("id") % 100 == 0, pivots=3, block=8))) == sorted(want)


def test_topk_stops_where_vectors_are_clustered(spark, as_rows, monkeypatch):
    """Tight clusters about far centres: the bound leaves most pairs unscored, with the same result."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 16)) * 20
    rows = [(k, (centres[k % 8] + rng.standard_normal(16) * 0.01).tolist()) for k in range(800)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    exact = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows]
    met, real = [], topk._meet
    monkeypatch.setattr(topk, "_meet", lambda q, b, near, part: met.append(q.join(b.select("pivot", "low", "high"), "pivot").where(near).count()) or real(q, b, near, part))
    got = as_rows(topk.search(df, "vec_id", "embedding", F.col("id") % 20 == 0, pivots=8, block=16))
    assert sorted(got) == plain_topk(exact, lambda i: i % 20 == 0)
    assert sum(met) < 0.7 * 40 * 56  # of 40 queries and at least 56 blocks


def test_token_counts_of_long_white_space(spark):
    encoder = K.encoder(RANKS)
    short = K.Encoder(RANKS, run=2)
    rng = np.random.default_rng(3)
    for _ in range(400):
        text = "".join(rng.choice(list(" \n\t\u00a0\u3000ab1.'s"), rng.integers(0, 40), p=[0.3, 0.15, 0.05, 0.05, 0.05, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]))
        assert short.ids(text) == encoder.encoding.encode_ordinary(text)
    n = 1_000_000
    texts = [" " * n, "\n" * n, "a" * n, "x" + " " * n + "y", " \n" * (n // 2)]
    rows = K.by_section(spark.createDataFrame([(k, t) for k, t in enumerate(texts) if "\n" not in t], "doc_id bigint, text string"), RANKS).collect()
    assert {r.doc_id: r.length for r in rows} == {0: n, 2: n, 3: n + 2}
    for t in texts:
        assert encoder.lengths(t).sum() == len(t)


def test_pieces_of_long_runs_take_seconds():
    import time

    t = piece_fst.Transducer(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(6)
    for _ in range(300):
        text = "".join(rng.choice(list("▁▁aetnohils."), rng.integers(1, 80)))
        assert t._scan(text) == t._queue(text)
    for text in (" " * 100_000, "a" * 100_000, "\n" * 100_000, "ab" * 50_000, "x" + " " * 50_000 + "y"):
        began = time.perf_counter()
        ids = np.frombuffer(t.encode(text), "<u4").tolist()
        assert time.perf_counter() - began < 5
        assert ids[:2000] == library.encode(text)[:2000] and t.decode(t.encode(text)) == text


def test_allocation_rules():
    lengths, bounds = np.array([2, 3, 4, 1]), np.array([0, 4, 4, 6, 10])
    assert K.allocate(lengths, bounds, "start")[0].tolist() == [2, 0, 1, 1]
    assert K.allocate(lengths, bounds, "majority")[0].tolist() == [2, 0, 0, 2]
    count, crosses = K.allocate(lengths, bounds, "split")
    assert np.allclose(count, [1 + 2 / 3, 0, 1 / 3 + 1 / 4, 3 / 4 + 1]) and crosses.tolist() == [1, 0, 1, 0]
    assert K.allocate(np.zeros(0, int), np.array([0, 0]))[0].tolist() == [0]


def test_sections(odd, odd_rows, empty):
    encoding = K.encoder(RANKS).encoding
    got = {}
    for r in K.by_section(odd.where("doc_id != 2"), RANKS).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in odd_rows:
        if d in (2, None):
            continue
        text = t or ""
        raw = text.encode()
        lines = raw.split(b"\n")
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        rows = sorted(got[d], key=lambda r: r.section)
        assert [raw[r.start : r.start + r.length] for r in rows] == lines
        want, at = [0] * len(lines), 0
        ends = np.cumsum([len(x) for x in lines])
        for token in encoding.encode_ordinary(text):
            want[int(np.searchsorted(ends, at, "right"))] += 1
            at += len(encoding.decode_single_token_bytes(token))
        assert [r.n_tokens for r in rows] == want
    fields = K.by_section(odd.where("doc_id = 13").withColumn("title", F.lit(None).cast("string")), RANKS, ["title", "text"], "split").collect()
    assert [(r.section, r.start, r.length) for r in fields] == [(0, 0, 1), (1, 1, 7)]
    assert sum(r.n_tokens for r in fields) == pytest.approx(len(encoding.encode_ordinary("\none two")))
    assert K.by_section(empty, RANKS).collect() == []
    with pytest.raises(ValueError):
        K.by_section(empty, RANKS, rule="none")


def test_pieces_equal_the_library(spark, odd, odd_rows, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = piece_fst.Transducer(PIECES)
    rng = np.random.default_rng(0)
    texts = ["", " ", "   ", "a   b", "\n\n\ta", "日本語 テスト", "🙂 ok", "▁▁ a", "<s> </s> <0x41>", "naïve — “q”", "a" * 50, "    " * 9, "def f(x):\n        return  x", "\x00a"]
    texts += ["".join(rng.choice(list("abcdeéßÇ  .,!?\n1"), rng.integers(1, 60))) for _ in range(500)]
    for x in texts + [r[1] or "" for r in odd_rows]:
        ids = np.frombuffer(t.encode(x), "<u4").tolist()
        assert ids == library.encode(x)
        assert t.decode(t.encode(x)) == library.decode(ids)
    got = {r.doc_id: r for r in piece_fst.digest(odd, PIECES).collect()}
    for d, x in odd_rows:
        ids = np.array(library.encode(x or ""), "<u4")
        assert (got[d].n_pieces, got[d].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert got[d].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in piece_fst.decode(piece_fst.encode(odd, PIECES), PIECES).collect()}
    assert back == {d: x or "" for d, x in odd_rows}
    assert piece_fst.digest(empty, PIECES).collect() == []


def test_audit_finds_each_kind_of_damage(spark, as_rows):
    kind = "file string, offset bigint, length bigint, sha string, place int"
    rows = [(f"f{f}", n * 10, 10, f"{f}-{n}", 0) for f in range(40) for n in range(37)]
    same = spark.createDataFrame(rows, kind)
    assert M.audit(same, same).collect() == []
    other = [r for r in rows if r[:2] != ("f3", 360)]
    other = [(f, o, n, "bad", 0) if (f, o) in (("f0", 0), ("f39", 200)) else (f, o + (1 if (f, o) == ("f5", 360) else 0), n, s, 0) for f, o, n, s, _ in other]
    other += [("new", 0, 10, "x", 0), (None, None, None, None, 0)]
    got = as_rows(M.audit(same, spark.createDataFrame(other, kind).repartition(5)).select("file", "kind", "offset_a", "offset_b"))
    assert got == sorted([("f0", "altered", 0, 0), ("f39", "altered", 200, 200), ("f3", "missing", 360, None), ("f5", "moved", 360, 361), ("new", "extra", None, 0), (None, "extra", None, None)], key=repr)
    a, b = (dict(as_rows(M.roots(x))) for x in (same, spark.createDataFrame(rows[:-1] + [("f39", 360, 10, "z", 0)], kind)))
    assert sum(a[k] != b[k] for k in a) == 1 and len(a) == 40
    assert M.audit(same.limit(0), same.limit(0)).collect() == []


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "<p>ü\r\n\r\n</p>"), (2, None, None)], "page_id bigint, url string, html string")
    text = M.record(F.col("url"), F.col("page_id"), F.col("html"))
    listed = M.inventory(pages, F.lit("one"), [F.col("page_id")], text)
    offsets = [0, listed.orderBy("offset").first()["length"]]
    whole = M.assemble(pages.select(F.lit("one").alias("file"), F.element_at(F.array(*map(F.lit, offsets)), F.col("page_id").cast("int")).alias("offset"), text.alias("record")))
    (tmp_path / "one.warc").write_bytes(bytes(whole.first()["content"]))
    read = M.parse(spark.read.format("binaryFile").load(str(tmp_path / "one.warc")))
    assert [(r.uri, bytes(r.payload).decode()) for r in read.orderBy("offset").collect()] == [("http://a/é", "<p>ü\r\n\r\n</p>"), ("", "")]
    key = lambda d: sorted(tuple(r) for r in d.select("offset", "length", "sha").collect())
    assert key(read) == key(listed)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = catalogue.substring_dedup.scratch.save(stage(spark, before, sf), "stage")
        if name == "quality_filter":
            assert after.columns == docs.columns and 0.75 * docs.count() < after.count() < docs.count()
        elif name == "near_duplicates":
            keep = kept([(r.doc_id, r.text) for r in before.collect()])
            assert sorted({r.doc_id for r in after.collect()}) == keep and after.columns == docs.columns
        elif name == "repeated_passages":
            want = {d: n - gone for d, n, gone, _ in brute([(r.doc_id, r.text) for r in before.collect()], 50)}
            assert {r.doc_id: len((r.text or "").encode().split()) for r in after.collect()} == want
        else:
            assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    assert after.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracles(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = c.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = catalogue.queries()[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(cursor.fetchall())
