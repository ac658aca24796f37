from quillspark.plans import catalogue


def test_titles_that_differ_after_80_characters(spark, tmp_path):
    head = " ".join(f"word{k:02}" for k in range(14))  # 97 characters
    tails = {2: "one " * 30, 4: "two " * 30, 5: "two " * 30, 7: "six " * 30}
    rows = [(k, f"{head} {t}\nbody", "en", "web", 9) for k, t in tails.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["left_id"], r["right_id"], r["stage"]) for r in catalogue.queries()["cascade_match"](spark, str(tmp_path)).collect()}
    assert found == {(2, None, "left_only"), (4, 5, "title"), (None, 7, "right_only")}
    fuzzy = {(r["left_id"], r["right_id"], r["score"]) for r in catalogue.queries()["fuzzy_match"](spark, str(tmp_path)).collect()}
    assert fuzzy == {(4, 5, 1.0)}
