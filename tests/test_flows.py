import json

import pytest
from pyspark.sql import functions as F
from test_sources import PROGRAM

from quillspark.plans import flows


def test_label_writes_sheet_and_json(spark, tmp_path):
    data = [(0, "Wifi sensing", "A", "", "We use RSSI.", "IMC", 2023), (1, "Compiler passes", "B", "", "", "IMC", 2024), (2, "Old", "C", "", "", "IMC", 2020)]
    papers = spark.createDataFrame(data, "ord int, title string, authors string, doi string, abstract string, venue string, year int")
    out = flows.label(papers, [2023, 2024], sheet=str(tmp_path / "s"), json=str(tmp_path / "j"))
    assert {r.title: r.label for r in out.papers.collect()} == {"Wifi sensing": "yes", "Compiler passes": "no"}
    assert {(r.level, r.venue, r.year): (r.total, r.yes, r.no) for r in out.by_year.collect()} == {(0, "IMC", 2023): (1, 1, 0), (0, "IMC", 2024): (1, 0, 1), (1, "IMC", None): (2, 1, 1), (3, None, None): (2, 1, 1)}
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 2
    assert sorted((r.year, r.total_papers, r.papers[0].label) for r in spark.read.json(f"{tmp_path}/j.json").collect()) == [(2023, 1, "yes"), (2024, 1, "no")]


def test_coverage_fills_dois_first(spark):
    item = json.dumps({"message": {"items": [{"DOI": "10.1/A", "title": ["First paper here"]}]}})
    papers = spark.createDataFrame([(1, "First paper here", "", "text", "IMC", 2023, item), (2, "Second one", None, None, "IMC", 2023, item)], "id int, title string, doi string, abstract string, venue string, year int, answer string")
    cache = spark.createDataFrame([], "title_key string, doi string, provider string")
    answers = spark.createDataFrame([(2, "http://a/b.pdf"), (1, "")], "id int, pdf_url string")
    got = flows.coverage(papers, cache, {"crossref": F.col("answer")}, answers).collect()
    assert [tuple(r) for r in got] == [("IMC", 2023, 2, 1, 1, 1, 50.0)]


def test_pages_without_papers_fall_back_to_a_model(spark):
    pages = spark.createDataFrame([(1, None, PROGRAM), (2, None, "<p>none</p>")], "page_id bigint, url string, html string")
    assert {r.page_id for r in flows.seeds(pages, "IMC", 2024).collect()} == {1}
    reply = F.lit('[{"title": "From the model", "authors": ["A B"]}]')
    got = flows.seeds(pages, "IMC", 2024, reply).collect()
    assert [(r.page_id, r.title, r.authors, r.venue, r.year) for r in got if r.page_id == 2] == [(2, "From the model", ["A B"], "IMC", 2024)]
    assert "From the model" not in {r.title for r in got if r.page_id == 1} and len(got) == 3


def test_pages_from_files_and_addresses(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>\nfile</p>")
    path = str(tmp_path / "p.html")
    fetch = lambda urls: [f"<p>{u}</p>" for u in urls]
    got = {r.url.split("/")[-1]: r.html for r in flows.pages(spark, [path, "https://a/q"], fetch).collect()}
    assert got == {"p.html": "<p>\nfile</p>", "q": "<p>https://a/q</p>"}
    assert flows.pages(spark, [f"file://{path}"]).count() == 1
    with pytest.raises(ValueError):
        flows.pages(spark, ["http://a/q"])


@pytest.fixture(scope="module")
def records(spark):
    kind = "ord int, name string, keys array<string>, modalities string, osi_layers string, environment string, availability_url string, availability_notes string, doi string"
    data = [(0, "CitySense", ["a"], "rf", "L1", "Lab", "http://x.org/d", "", ""), (1, "City Traces 5", ["b"], "logs", "L3", "Lab", "https://x.org/d/", "", ""), (2, "WaveSet", ["c"], "audio", "L1", "Lab", "", "", ""), (3, "WaveSets", ["d"], "audio", "L1", "Lab", "", "", ""), (4, "Quite else", ["e"], "video", "L7", "Lab", "", "", "")]
    return spark.createDataFrame(data, kind)


def test_reconcile(records, spark, tmp_path):
    out = flows.reconcile(records, report=str(tmp_path / "r"), sheet=str(tmp_path / "c"))
    assert sorted((r.name_a, r.name_b, r.method) for r in out.matches.collect()) == [("CitySense", "City Traces 5", "url_dedup"), ("WaveSet", "WaveSets", "similarity")]
    assert {tuple(sorted(r.all_names)) for r in out.canonical.collect()} == {("City Traces 5", "CitySense"), ("WaveSet",), ("WaveSets",), ("Quite else",)}
    told = spark.read.json(str(tmp_path / "r")).collect()
    assert {(r.total_records, r.a["name"], tuple(r.b["keys"])) for r in told} == {(5, "CitySense", ("b",)), (5, "WaveSet", ("d",))}
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4


def test_reconcile_by_parts_and_with_a_model(records):
    pairs = lambda **k: sorted((r.name_a, r.method, r.confidence) for r in flows.reconcile(records, **k).matches.collect())
    assert pairs(by_likeness=False) == [("CitySense", "url_dedup", 0.95)]
    assert [m for _, m, _ in pairs(by_url=False)] == ["similarity"]
    said = lambda text: F.lit(text).cast("string")
    assert ("WaveSet", "llm_confirmed", 0.9) in pairs(reply=said('```json\n{"verdict": " Yes", "reason": "same"}\n```'))
    assert pairs(reply=said('{"verdict": "no"}')) == [("CitySense", "url_dedup", 0.95)]
    for text, reason in (('{"verdict": "unsure", "reason": "r"}', "LLM unsure: r"), ("prose", "LLM unsure: Could not parse LLM response"), (None, "LLM unsure: LLM call failed; flagging for human review")):
        got = flows.reconcile(records, by_url=False, reply=said(text)).matches.collect()
        assert ("WaveSet", "llm_unsure", 0.7, reason) in {(r.name_a, r.method, r.confidence, r.reason) for r in got}
