import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import classify, models as M


def test_order_and_settings():
    assert M.order("B", "a, b", ("a", "b")) == ["b", "a"]
    with pytest.raises(ValueError):
        M.order("x", "", ("a",))
    assert M.settings("# c\nA = '1'\nB=2\nbad", {"B": "3", "C": "4"}) == {"A": "1", "B": "3"}


def test_router():
    waits, state = [], []

    def flaky(prompt):
        state.append(prompt)
        if len(state) < 3:
            raise M.CallFailed(503, "busy")
        return "late"

    def broken(prompt):
        raise M.CallFailed(400, "bad")

    def spent(prompt):
        raise M.CallFailed(402, "Insufficient credit")

    ask = M.router({"a": broken, "b": flaky}, ["a", "missing", "b"], waits.append)
    assert ask("x") == "late" and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError, match="no provider"):
        M.router({"a": broken}, ["a"], waits.append)("x")
    with pytest.raises(M.CreditExhausted):
        M.router({"a": spent, "b": flaky}, ["a", "b"], waits.append)("x")


def test_replies_and_input(spark):
    def ask(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "p string").select("p", M.replies(ask)(F.col("p")).alias("r"))
    assert sorted(((r.p, r.r.reply, r.r.error) for r in df.collect()), key=repr) == sorted([("a", "A", None), ("bad", None, "no"), (None, None, None)], key=repr)
    papers = spark.createDataFrame([("t", None, "x" * 201), ("t", "abs", "short"), ("t", " ", None)], "title string, abstract string, pdf_text string")
    assert [r.extraction_source for r in M.extraction_input(papers).collect()] == ["pdf_text_fallback", "abstract", "title_only"]


def test_a_prompt_is_asked_once_for_all_its_papers(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("label string, confidence double")
    def model(prompts: pd.Series) -> pd.DataFrame:
        asked.add(len(prompts))
        return pd.DataFrame({"label": ["yes"] * len(prompts), "confidence": [0.5] * len(prompts)})

    papers = spark.createDataFrame([(n, f"p{n % 3}" if n % 7 else None) for n in range(60)], "id int, text string").repartition(5)
    key = T.content_key(F.lit("a"), F.lit("m"), F.col("text"))
    cache = papers.where("text = 'p1'").select(key.alias("key"), F.lit("no").alias("label"), F.lit(0.9).alias("confidence")).distinct()
    out = classify.with_cache(papers, cache, model, F.col("text"), "a", "m").collect()
    assert asked.value == 3 and len(out) == 60  # p0, p2 and the null prompt
    assert {(r.text, r.label, r.cached) for r in out} == {("p0", "yes", False), ("p1", "no", True), ("p2", "yes", False), (None, "yes", False)}
    classify.with_cache(papers, cache, model, F.col("text"), "a", "m", refresh=True).collect()
    assert asked.value == 7
