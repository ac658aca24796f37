import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import quality as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.digest(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for d, r in rows.items())
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    score, label = np.array(held).T
    assert np.mean((score >= 0.5) == label) > 0.93
    assert (score[label == 1] >= 0.5).mean() > 0.98
    assert np.mean(score[label == 1][:, None] > score[label == 0]) > 0.98


def test_training_is_deterministic_and_blind_to_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(Q.trainable(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = Q.fit(docs, labels), Q.fit(docs.repartition(5), flipped)
    assert (a.table == b.table).all() and a.shift == b.shift


def test_blocks_and_long_texts_pool_alike(monkeypatch):
    rng = np.random.default_rng(0)
    model = Q.Model(rng.standard_normal((Q.SYMBOLS, Q.DIM)).astype(np.float32), rng.standard_normal((Q.WIDTH * Q.DIM, Q.FILTERS)).astype(np.float32), np.zeros(Q.FILTERS, np.float32), rng.standard_normal(Q.FILTERS).astype(np.float32), 0.1)
    texts = [b"", b"a", b"word " * 400, b"x" * 31, b"y" * 33, b"last words"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = model.pooled(Q.Chunks(data, offsets))
    monkeypatch.setattr(Q, "BLOCK", 7)
    assert np.allclose(model.pooled(Q.Chunks(data, offsets)), whole, rtol=1e-4, atol=1e-3)
    alone = [model.pooled(Q.Chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0] for t in texts]
    assert np.allclose(alone, whole, rtol=1e-4, atol=1e-3)


def test_every_byte_is_in_a_chunk():
    for n in (1, 15, 31, 32, 33, 47, 48, 49, 500):
        c = Q.Chunks(np.full(n, 65, np.uint8), np.array([0, n]))
        rows = c.rows(slice(None))
        seen = {s + k for s, r in zip(c.start, rows) for k in range(Q.WIDTH) if r[k] != Q.PAD}
        assert seen == set(range(n))


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (7, None, 1)], "doc_id bigint, quality int, toxic int")
    got = Q.digest(odd, labels).collect()
    assert len(got) == len(odd_rows) and {r["score"] for r in got} == {got[0]["score"]}  # one label: a constant
    assert Q.digest(empty, labels).collect() == []
    kept = Q.accept(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    rng = np.random.default_rng(1)
    model = Q.train([b"good words here " * 9, b"$$$ %%% &&& " * 9] * 20, np.array([1, 0] * 20))
    scores = {r["doc_id"]: r["s"] for r in odd.select("doc_id", Q.scorer(model)("text").alias("s")).collect()}
    assert scores[3] == scores[4] and all(0 <= s <= 1 for s in scores.values()) and rng is not None
