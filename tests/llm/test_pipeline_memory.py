"""What the stages of the pipeline leave in long-lived executors and Python workers."""

import shutil

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import catalogue

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def batch_bytes(spark):
    before = spark.conf.get(KEY)
    yield
    spark.conf.set(KEY, before)


def _largest(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    return spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("x"), 4000)).mapInArrow(run, "n long").agg(F.max("n")).first()[0]


def _docs(spark):
    return spark.createDataFrame([(1, "one two three", "en", "s", 13), (2, "four five", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_texts_reach_python_in_small_batches(spark, sf, batch_bytes, k):
    spark.conf.unset(KEY)
    corpus_pipeline.STAGES[k][1](spark, _docs(spark), sf)
    assert _largest(spark) < 5_000_000


@pytest.mark.parametrize("given, then", [("100000b", "100000b"), ("100000", "100000"), ("2m", "2m"), ("512KB", "512KB"), ("64m", "4194304b"), ("1g", "4194304b"), ("8388608", "4194304b")])
def test_smaller_batches_of_the_session_stay(spark, sf, batch_bytes, given, then):
    spark.conf.set(KEY, given)
    corpus_pipeline._small_batches(lambda *_: None)(spark, None, sf)
    assert spark.conf.get(KEY) == then


def test_workers_keep_no_tokenizer(spark, sf, batch_bytes, tmp_path, monkeypatch):
    path = str(tmp_path / "copy.json")
    shutil.copy(catalogue.vocabulary("word_bpe_49k.json"), path)
    monkeypatch.setattr(catalogue, "vocabulary", lambda name: path)
    assert dict(corpus_pipeline.STAGES)["packed_sequences"](spark, _docs(spark), sf).count() == 2

    def kept(batches):
        from quillspark.llm import word_tokens

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(word_tokens._kept), pa.string())], ["path"])

    assert path not in {r["path"] for r in spark.range(0, 16, 1, 16).mapInArrow(kept, "path string").collect()}
