import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import classify, enrich, ledger, store
from quillspark.sources import writers

RUN = "id bigint, instance_id bigint, stage string, status string, message string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "runs": make([(1, 7, "ingest", "completed", None), (2, 7, "extract-datasets", "completed", None), (3, 7, "classify-candidates", "completed", None), (4, 8, "extract-datasets", "running", None)], RUN),
        "papers": make([(10, 7), (11, 8)], "id bigint, instance_id bigint"),
        "predictions": make([(3, "yes"), (3, "no"), (9, "no")], "run_id bigint, label string"),
        "claims": make([(2, 100), (2, None), (4, 101), (4, None)], "run_id bigint, dataset_id bigint"),
        "bibtex": make([(10, "@a"), (11, "@b")], "paper_id bigint, entry string"),
        "datasets": make([(100, "old"), (101, "used"), (102, "never")], "id bigint, name string"),
        "texts": make([(10, "pdf"), (11, "pdf")], "paper_id bigint, kind string"),
    }


@pytest.fixture(scope="module")
def places(spark):
    instances = spark.createDataFrame([(7, 1, 2023), (8, 1, 2024)], "id bigint, venue_id bigint, year int")
    return instances, spark.createDataFrame([(1, "NSDI")], "id bigint, name string")


def test_prune_of_one_stage_keeps_the_others(tables, places):
    gone = ledger.doomed(tables["runs"], *places, venue="nsdi", year=2023, stage="extract-datasets")
    after = ledger.pruned(tables, gone, "extract-datasets")
    assert rows(ledger.removed(tables, after)) == [("bibtex", 1), ("claims", 2), ("datasets", 2), ("runs", 1)]
    assert rows(after["datasets"]) == [(101, "used")] and rows(after["predictions"]) == rows(tables["predictions"])


def test_prune_of_all_stages_and_texts(tables, places):
    gone = ledger.doomed(tables["runs"], *places, venue="NSDI", year=2023)
    after = ledger.pruned(tables, gone, keep_texts=False)
    assert rows(ledger.removed(tables, after)) == [("bibtex", 1), ("claims", 2), ("datasets", 2), ("predictions", 2), ("runs", 3), ("texts", 1)]


def test_prune_by_number_and_its_errors(tables, places):
    assert [r.id for r in ledger.doomed(tables["runs"], *places, number=4).collect()] == [4]
    with pytest.raises(ValueError, match="Run 5 not found"):
        ledger.doomed(tables["runs"], *places, number=5)
    with pytest.raises(ValueError):
        ledger.doomed(tables["runs"], *places, venue="NSDI")
    assert ledger.doomed(tables["runs"], *places, venue="IMC", year=2023).count() == 0


def test_run_log(tables, places):
    log = ledger.started(tables["runs"], 8, "ingest", 5)
    assert rows(ledger.required(log, 5))[0][3:] == ("running", None)
    log = ledger.completed(log, 5, "12 papers")
    assert rows(ledger.required(log, 5))[0][3:] == ("completed", "12 papers") and rows(ledger.required(log, 4))[0][3] == "running"
    assert ledger.already_ingested(tables["papers"], log, 7) == 1 and ledger.already_ingested(tables["papers"], log, 8) == 5
    assert ledger.already_ingested(tables["papers"], tables["runs"], 8) is None and ledger.already_ingested(tables["papers"], log, 9) is None
    assert [tuple(r)[:3] for r in ledger.recent(log, *places, most=2).collect()] == [(5, "NSDI", 2024), (4, "NSDI", 2024)]


def test_get_or_create_keeps_old_numbers_and_gives_new_ones_once(spark):
    known = spark.createDataFrame([("a", 5)], "name string, id bigint")
    want = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "name string")
    out = ledger.get_or_create(known, want, ["name"])
    got = rows(out)
    assert [r for r in got if r[0] == "a"] == [("a", 5)] and len({r[1] for r in got}) == len(got) == 4 and min(r[1] for r in got) == 5
    assert rows(ledger.get_or_create(known, want.repartition(3), ["name"])) == got
    empty = known.limit(0)
    assert ledger.get_or_create(empty, want, ["name"]).where("id > 0").count() == 4
    assert rows(ledger.with_id(want.distinct(), out, ["name"], "id", "n").where("name = 'a'")) == [("a", 5)]


def test_review_items_are_pending_unless_told(spark):
    queue = spark.createDataFrame([("low", "done")], "reason string, status string")
    plain = spark.createDataFrame([("double",)], "reason string")
    told = spark.createDataFrame([("x", "open"), ("y", None)], "reason string, status string")
    assert rows(ledger.review_items(queue, plain)) == [("double", "pending"), ("low", "done")]
    assert rows(ledger.review_items(queue, told)) == [("low", "done"), ("x", "open"), ("y", "pending")]


def test_arguments():
    assert ledger.years(" 2024 ") == [2024] and ledger.years("2023:2025") == [2023, 2024, 2025]
    for bad in ("x", "2023:", "2025:2023", ""):
        with pytest.raises(ValueError):
            ledger.years(bad)
    assert ledger.venue_year_pairs([" IMC : 2023 "]) == [("IMC", "2023")]
    for bad in ("IMC", ":2023", "IMC:"):
        with pytest.raises(ValueError):
            ledger.venue_year_pairs([bad])


def test_dois_by_title(spark):
    first = json.dumps({"message": {"items": [{"DOI": "10.1/ABC", "title": ["A Study of Things"]}]}})
    second = json.dumps({"results": [{"doi": "https://doi.org/10.2/XyZ", "title": "Other Words Entirely"}]})
    data = [(1, "A study of things", None, first, None), (2, "Other words entirely", "", first, second), (3, "Neither of them", None, first, second), (4, "  ", None, first, second), (5, "x", " 10.9/Own", None, None), (6, "Known miss", None, first, second), (7, "Known hit", None, "not json", None), (8, None, None, None, None)]
    papers = spark.createDataFrame(data, "id int, title string, doi string, first string, second string")
    cache = spark.createDataFrame([("title:known miss", "", "miss"), ("title:known hit", "10.5/q", "crossref")], "title_key string, doi string, provider string")
    got = enrich.resolved_dois(papers, cache, {"crossref": F.col("first"), "openalex": F.col("second")})
    assert {r.id: (r.doi, r.doi_provider) for r in got.collect()} == {
        1: ("10.1/abc", "crossref"), 2: ("10.2/xyz", "openalex"), 3: ("", "miss"), 4: ("", None), 5: ("10.9/Own", "given"), 6: ("", "miss"), 7: ("10.5/q", "crossref"), 8: ("", None),
    }


def test_bare_doi_and_contact(spark):
    one = spark.createDataFrame([(" https://doi.org/10.1/A ", "doi:10.1/b", "HTTP://DOI.ORG/x", "http://a/b?c=1")], "a string, b string, c string, u string")
    got = one.select(*(enrich.bare_doi(F.col(c)) for c in "abc"), enrich.with_mailto(F.col("u"), "me you@x.org"), enrich.with_mailto(F.lit("http://a"), "m@x"), enrich.with_mailto(F.lit("http://a"), " ")).first()
    assert tuple(got) == ("10.1/A", "10.1/b", "x", "http://a/b?c=1&mailto=me%20you%40x.org", "http://a?mailto=m%40x", "http://a")


def test_papers_without_a_label_are_extracted(spark):
    papers = spark.createDataFrame([(k,) for k in range(1, 6)], "id int")
    labels = spark.createDataFrame([(1, "yes"), (2, "maybe"), (3, "no"), (4, None)], "id int, label string")
    assert rows(classify.to_extract(papers, labels)) == [(1,), (2,), (4,), (5,)]
    assert rows(classify.to_extract(papers, labels, "high")) == [(1,), (4,), (5,)]


def test_cache_sections(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"llm": {"k": {"x": 1}, "bad": 3, "worse": "s"}, "unknown": {"k": {}}, "oa": []}))
    (tmp_path / "b.json").write_text("{not json")
    cache = store.load_cache(spark, str(tmp_path / "*.json"), ("llm", "oa"))
    assert [(r.section, r.key, json.loads(r.value)) for r in cache.collect()] == [("llm", "k", {"x": 1})]
    two = cache.unionByName(cache.withColumn("section", F.lit("oa")))
    kept, gone = store.cleared(two, ("llm", "oa"), "oa")
    assert gone == 1 and rows(store.sections(kept)) == [("llm", 1)]
    kept, gone = store.cleared(two, ("llm", "oa"))
    assert gone == 2 and kept.count() == 0
    with pytest.raises(ValueError):
        store.cleared(two, ("llm", "oa"), "dois")


def test_sheets_of_an_extraction(spark, tmp_path):
    kind = "array<struct<name:string,relationship_type:string,osi_layers:array<string>,modalities:array<string>,availability:boolean,availability_url:string,availability_notes:string,collection_environment:string,usage_count:bigint>>"
    used, own = ("D", "reused", ["L1", "L2"], ["rf"], True, "u", None, "Lab", 0), ("D", "introduced", [], [], False, None, None, None, 0)
    data = [(0, "T0", "A", "V", 2023, "k0", "10.1/x", "@x", [used]), (1, "T1", "B", "V", 2023, "k1", "", "@y", [own, ("E", "unclear", [], [], None, None, None, None, 9)]), (2, "T2", "C", "V", 2023, "k2", None, "", [])]
    papers = spark.createDataFrame(data, f"ord int, title string, authors string, venue string, year int, bibtex_key string, doi string, bibtex string, datasets {kind}")
    assert [tuple(r) for r in writers.extraction_datasets(papers).collect()] == [("D", "k1", "L1; L2", "rf", "Y", "u", "", "Lab", 2), ("E", "k1", "", "", "", "", "", "", 9)]
    writers.extraction(papers, str(tmp_path), "v_2023")
    read = lambda n: spark.read.csv(f"{tmp_path}/v_2023_{n}.csv", header=True, escape='"').collect()
    assert sorted((r["Paper Title"], r["Datasets"]) for r in read("papers")) == [("T0", "D"), ("T1", "D; E"), ("T2", None)]
    assert sorted((r["Bibtex Citation Key"], r["DOI Version of Key"]) for r in read("bibtex")) == [("k0", "doi:10.1/x"), ("k1", None), ("k2", None)]
    assert spark.read.json(f"{tmp_path}/v_2023_raw.json").first()["total_papers"] == 3


def test_match_report_has_the_surest_first_and_keeps_their_order(spark):
    m = spark.createDataFrame([(0, "url", 0.8, "r", "a", ["k"], "b", []), (1, "name", 0.9, "r", "c", [], "d", []), (2, "url", 0.8, "s", "e", [], "f", [])], "ord int, method string, confidence double, reason string, name_a string, keys_a array<string>, name_b string, keys_b array<string>")
    got = writers.match_report(m, 12).collect()
    assert [(r.total_records, r.a["name"], r.b["name"]) for r in got] == [(12, "c", "d"), (12, "a", "b"), (12, "e", "f")]
