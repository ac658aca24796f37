import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import classify, enrich, match, metrics, records, resolve, store


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_keyword_labels(spark):
    data = [
        (1, "Surfing the branch predictor in compiler land", None),
        (2, "Wi-Fi sensing", "abstract"),
        (3, "Millimeter wave links", ""),
        (4, "Congestion in 802.11 networks", "LTE, 5G and radio"),
        (5, "A study", " "),
        (6, "TCP at scale", "x"),
    ]
    got = {r["id"]: r for r in classify.keyword(spark.createDataFrame(data, "id int, title string, abstract string")).collect()}
    assert (got[1]["label"], got[1]["confidence"], got[1]["evidence"]) == ("no", 0.65, "category=not_relevant; computing_terms=compiler; abstract_missing=true")
    assert (got[2]["label"], got[2]["confidence"]) == ("yes", 0.95)  # wifi and wi-fi
    assert got[3]["label"] == "yes"
    assert (got[4]["label"], got[4]["confidence"]) == ("yes", 0.97)
    assert (got[5]["label"], got[5]["confidence"], got[5]["used_abstract"]) == ("maybe", 0.55, False)
    assert (got[6]["label"], got[6]["confidence"]) == ("no", 0.82)


def test_labels_through_a_cache(spark):
    papers = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    model = lambda p: F.struct(F.lit("Perhaps").alias("label"), F.lit(0.4).alias("confidence"))
    key = papers.where("id = 1").select(classify.T.content_key(F.lit("p"), F.lit("m"), F.col("title"))).first()[0]
    cache = spark.createDataFrame([(key, "yes", 0.9)], "key string, label string, confidence double")
    out = classify.with_cache(papers, cache, model, F.col("title"), "p", "m")
    assert rows(out, "id", "label", "confidence", "cached") == [(1, "yes", 0.9, True), (2, "maybe", 0.4, False)]


def test_a_model_sees_only_what_the_cache_lacks(spark, tmp_path):
    import uuid

    from pyspark.sql.functions import pandas_udf

    folder = str(tmp_path)

    @pandas_udf("label string, confidence double")
    def model(prompts: pd.Series) -> pd.DataFrame:
        for p in prompts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(p))
        return pd.DataFrame({"label": ["no"] * len(prompts), "confidence": [0.3] * len(prompts)})

    papers = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "id int, title string")
    keys = papers.where("id < 4").select(classify.T.content_key(F.lit("p"), F.lit("m"), F.col("title")).alias("key"))
    cache = keys.select("key", F.lit("yes").alias("label"), F.lit(0.9).alias("confidence"))
    out = classify.with_cache(papers, cache, model, F.col("title"), "p", "m")
    assert rows(out, "id", "label", "cached") == [(k, "yes" if k < 4 else "no", k < 4) for k in range(6)]
    assert sorted(f.read_text() for f in tmp_path.iterdir()) == ["t4", "t5"]
    assert {r["cached"] for r in classify.with_cache(papers, cache, model, F.col("title"), "p", "m", refresh=True).collect()} == {False}


def test_url_pairs_against_all_pairs(spark):
    import random

    from quillspark.operators import resolve

    for seed in range(4):
        rng = random.Random(seed)
        data = [(k, f"n{rng.randrange(5)}", [f"k{rng.randrange(3)}"], f"https://d.org/{rng.randrange(3)}") for k in range(40)]
        first = {}
        for i, n, x, u in data:
            for j, m, y, v in data:
                if i < j and u == v and x != y:
                    names = tuple(sorted((n, m)))
                    first[names] = min(first.get(names, (i, j, u)), (i, j, u))
        table = spark.createDataFrame(data, "ord int, name string, keys array<string>, availability_url string").withColumns({"doi": F.lit(None).cast("string"), "availability_notes": F.lit("")})
        assert rows(resolve.url_pairs(table), "ord_a", "ord_b") == sorted((x[:2] for x in first.values()), key=repr)


def test_cascade(spark):
    schema = "venue string, ord int, id string, title string, doi string"
    a = spark.createDataFrame([("v", 1, "a1", "one", "10.1/x"), ("v", 2, "a2", "two words", ""), ("v", 3, "a3", "fuzzy title of paper", "")], schema)
    b = spark.createDataFrame([("v", 1, "b3", "fuzzy title of papers", ""), ("v", 2, "b2", "two words", ""), ("v", 3, "b1", "other", "10.1/x")], schema)
    got = rows(match.cascade(a, b, ["venue"], 0.8), "left_id", "right_id", "stage")
    assert got == [("a1", "b1", "doi"), ("a2", "b2", "title"), ("a3", "b3", "fuzzy")]
    off = rows(match.cascade(a, b, ["venue"], 1.0), "left_id", "right_id", "stage")
    assert ("a3", None, "left_only") in off and (None, "b3", "right_only") in off


def test_cascade_of_one_sided_groups(spark):
    schema = "venue string, ord int, id string, title string, doi string"
    a = spark.createDataFrame([("v", 1, "a1", "one", ""), (None, 2, "a2", None, None)], schema)
    b = spark.createDataFrame([("w", 1, "b1", "one", ""), (None, 2, "b2", "x", "")], schema)
    assert rows(match.cascade(a, b, ["venue"]), "venue", "left_id", "right_id", "stage") == [("v", "a1", None, "left_only"), ("w", None, "b1", "right_only"), (None, "a2", None, "left_only"), (None, None, "b2", "right_only")]
    assert match.cascade(a.limit(0), b.limit(0), ["venue"]).collect() == []


def test_cascade_ties_take_the_last_and_consume(spark):
    schema = "venue string, ord int, id string, title string, doi string"
    a = spark.createDataFrame([("v", 1, "a1", "abcd", ""), ("v", 2, "a2", "abcx", "")], schema)
    b = spark.createDataFrame([("v", 1, "b1", "abcy", ""), ("v", 2, "b2", "abcz", "")], schema)
    assert rows(match.cascade(a, b, ["venue"], 0.7), "left_id", "right_id") == [("a1", "b2"), ("a2", "b1")]


def test_title_guard(spark):
    e, a = "one two three four five six seven", "One, two three four five six eight"
    df = spark.createDataFrame([(1, e, a), (2, e, e + " 8 9 10 11"), (3, e, e + " 8 9 10 11 12"), (4, "", "")], "id int, e string, a string")
    assert rows(df.where(match.title_guard(F.col("e"), F.col("a"))), "id") == [(1,), (2,)]
    pairs = match.guard_join(df.select("id", F.col("e").alias("title")), df.select("id", F.col("a").alias("title")))
    want = [(x, y) for x in (1, 2, 3) for y in (1, 2)]
    assert rows(pairs, "expected_id", "actual_id") == want


def test_rollup(spark):
    counts = spark.createDataFrame([("v", "2022", 1, 0, 1), ("v", "2023", 2, 1, 0)], "venue string, year string, tp int, fp int, fn int")
    got = {(r["level"], r["year"]): r for r in metrics.rollup(counts).collect()}
    assert (got[1, None]["tp"], got[1, None]["fp"], got[1, None]["fn"], got[3, None]["jaccard"]) == (3, 1, 1, 0.6)
    one = metrics.with_scores(spark.createDataFrame([(2, 1, 1), (0, 0, 0)], "tp int, fp int, fn int")).orderBy("tp").collect()
    assert (one[0]["jaccard"], one[1]["jaccard"], one[1]["precision"], one[1]["recall"]) == (0.0, 0.5, 0.6667, 0.6667)
    scoped = spark.createDataFrame([("v", "1", 2, 1, 2, 1, 1)], "venue string, year string, tp int, fp int, fn int, fn_missed int, fn_missing_from_universe int")
    assert metrics.rollup(scoped, scope_to_universe=True).where("level = 3").first()["jaccard"] == 0.5


RECORD = "ord int, name string, keys array<string>, modalities string, osi_layers string, environment string, availability_url string, availability_notes string, doi string"


def test_url_pairs(spark):
    df = spark.createDataFrame(
        [(1, "A", ["k1"], "", "", "", "https://x.org/d/", "", None), (2, "B", ["k2"], "", "", "", "", "at http://x.org/d", None), (3, "C", ["k1"], "", "", "", "https://x.org/d", "", None)], RECORD
    )
    assert rows(resolve.url_pairs(df), "name_a", "name_b", "confidence") == [("A", "B", 0.95), ("B", "C", 0.95)]


def test_similar_pairs(spark):
    df = spark.createDataFrame(
        [(1, "5G Network Throughput Dataset", ["a"], "m", "L1", "", "", "", None), (2, "5G Network Throughput Traces", ["b"], "m", "L1", "", "", "", None), (3, "Something else entirely", ["c"], "q", "L7", "", "", "", None)], RECORD
    )
    assert rows(resolve.similar_pairs(df), "name_a", "name_b", "confidence") == [("5G Network Throughput Dataset", "5G Network Throughput Traces", 0.8)]


def test_consolidate(spark):
    df = spark.createDataFrame(
        [(1, "Set", ["a"], "x", "L2, L1", "Lab", "", "", None), (2, "Set long", ["b"], "xyz", "L1", "", "http://u", "", None), (3, "Other", ["c", "a"], "", "", "Sim", "", "", None), (4, "Set", ["b"], "", "", "", "", "", None)], RECORD
    )
    links = spark.createDataFrame([("Set", "Set long", 0.95), ("Other", "Set", 0.70)], "name_a string, name_b string, confidence double")
    got = {r["canonical_name"]: r for r in resolve.consolidate(df, links).collect()}
    assert sorted(got) == ["Other", "Set long"]
    s = got["Set long"]
    assert (s["all_names"], s["keys"], s["modalities"], s["osi_layers"], s["environments"], s["availability_url"], s["merge_reason"]) == (["Set long", "Set"], ["a", "b"], "xyz", "L1, L2", ["Lab"], "http://u", "merged 2 name variants")


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(0, 30)] + [("x", "y")], "a string, b string")
    got = dict(rows(resolve.components(edges), "name", "root"))
    assert set(got.values()) == {"n00", "x"} and len(got) == 33


def test_records(spark):
    df = spark.createDataFrame(
        [(1, "figure 3", "introduced", 0.9), (2, "Smith2020-traces", "introduced", 0.6), (3, "data", "introduced", 0.9), (4, "our data", "introduced", 0.9), (5, "the traces", "reused", 0.9), (6, "CAIDA", "reused", 0.5), (7, "CAIDA", "reused", 0.4), (8, "500,000 users of mobile networks", "x", 0.9)],
        "id int, name string, rel string, c double",
    )
    assert rows(df.where(records.accepted(F.col("name"), F.col("rel"), F.col("c"))), "id") == [(2,), (4,), (6,)]


def test_review(spark):
    df = spark.createDataFrame([("", ["a"], 0.99), ("T  x", [], 0.4), ("t X", ["b"], 0.95)], "title string, authors array<string>, confidence double")
    assert [r[0] for r in rows(records.review(df), "reason")] == ["duplicate_title", "low_confidence", "missing_authors", "missing_title"]


def test_merge(spark):
    sheet = spark.createDataFrame([(1, "A Dataset", "", "2"), (2, "a", "k", "3"), (3, "B", "q", "x")], "ord int, name string, key string, number string")
    corpus = spark.createDataFrame([(1, "A Dataset", "p1"), (2, "a", "p2"), (3, "a", "p2")], "ord int, name string, paper string")
    assert rows(records.merge_sheets(sheet, records.corpus_counts(corpus)), "name", "key", "summed", "papers") == [("A Dataset", "k", 5, 2), ("B", "q", None, 1)]


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(1, "b", 2), (2, "c", 3), (2, "d", 4)], "k int, v string, o int")
    assert rows(store.insert_or_ignore(old, new, ["k"], "o"), "k", "v") == [(1, "a"), (2, "c")]
    assert rows(store.insert_or_replace(old, new, ["k"], "o"), "k", "v") == [(1, "b"), (2, "d")]
    with pytest.raises(ValueError):
        store.without_section(old, "x", ("abstracts",))


def test_open_access(spark):
    url = lambda v: F.lit(v)
    pick = lambda *o: spark.range(1).select(enrich.open_access([*o]).alias("x")).first()["x"]
    assert pick(("a", url("https://dl.acm.org/1")), ("b", url("https://x.org")))["provider"] == "b"
    assert pick(("a", url("https://dl.acm.org/1")), ("b", url("https://dl.acm.org/2")))["provider"] == "b"
    assert pick(("a", url(None))) is None


def test_fetched_in_batches(spark):
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None)], "id int, doi string")
    got = enrich.fetched(asked, "id", "doi", lambda batch: [f"<{b}>" for b in batch], 1)
    assert rows(got, "payload") == [("<x>",), ("<y>",)]


def test_retry():
    waits, state = [], [0]

    def call():
        state[0] += 1
        if state[0] < 3:
            raise OSError("429")
        return "done"

    assert enrich.with_retry(call, lambda e: True, waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(KeyError):
        enrich.with_retry(lambda: {}["x"], lambda e: False, waits.append)
