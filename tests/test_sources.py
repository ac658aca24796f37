import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import classify, metrics
from quillspark.sources import readers, writers
from quillspark.streaming import evidence


def test_paper_list_and_gold(spark, tmp_path):
    a = tmp_path / "p.csv"
    a.write_text('﻿Paper Title,Authors,Conference,Year\n"A, ""quoted""\ntitle","Ada L, Grace H",IMC,2024.0\nB,,NSDI,\n', encoding="utf-8")
    got = readers.paper_list(spark, str(a)).orderBy("ord").collect()
    assert (got[0]["title"], got[0]["authors"], got[0]["year"], got[0]["confidence"]) == ('A, "quoted"\ntitle', ["Ada L", "Grace H"], 2024, 0.99)
    assert (got[1]["authors"], got[1]["confidence"]) == ([], 0.60)
    g = tmp_path / "g.csv"
    g.write_text("title,doi,venue,year,wireless\nX,nan,IMC,2023,yes\nY,10.1/y,IMC,2023,no\n,,,,\n")
    assert readers.gold(spark, str(g)).count() == 2
    assert [r["title"] for r in readers.gold(spark, str(g), wireless_only=True).collect()] == ["X"]
    h = tmp_path / "h.csv"
    h.write_text("name\nx\n")
    with pytest.raises(ValueError):
        readers.gold(spark, str(h))


def test_bibtex(spark, tmp_path):
    f = tmp_path / "s.bib"
    f.write_text("@inproceedings{k1,\n  author = {Lovelace, Ada and Hopper, Grace},\n  title={A {T}est},\n  year = {2024},\n  doi={10.1/x},\n  abstract={last}\n}\n@misc{k2, title={Only}}\n")
    got = {r["key"]: r for r in readers.bibtex(spark, str(f)).collect()}
    assert got["k1"]["authors"] == ["Lovelace, Ada", "Hopper, Grace"] and got["k1"]["abstract"] == "last" and got["k1"]["year"] == 2024
    assert got["k2"]["confidence"] == 0.60


def test_labelled_blocks(spark):
    text = "--- PAPER ---\nTitle: One\nAuthors: Ryu Okubo, B\nDOI: 10.1145/3651890.3672226\nAbstract: a b\n--- PAPER ---\nTitle: Two\n"
    got = readers.labelled_blocks(spark.createDataFrame([(text,)], "text string")).orderBy("ord").collect()
    assert [(r["title"], r["doi"], r["confidence"]) for r in got] == [("One", "10.1145/3651890.3672226", 0.95), ("Two", "", 0.60)]


def test_runs(spark, tmp_path):
    run = {"venue": "IMC", "years": [2024], "runs": [{"venue": "IMC", "year": 2024, "papers": [{"title": "P", "datasets": [{"name": "D", "availability_url": "http://u"}, {"name": " "}]}]}]}
    (tmp_path / "imc_raw.json").write_text(json.dumps(run))
    (tmp_path / "master_raw.json").write_text(json.dumps(run))
    papers = readers.runs(spark, str(tmp_path / "*_raw.json"))
    assert papers.count() == 1
    assert [(r["name"], r["availability_url"]) for r in readers.records(papers).collect()] == [("D", "http://u")]


def test_index_records_and_venues(spark):
    hits = [("Editorship", "X", ["A"], "", ""), ("inproceedings", "Poster: X.", ["A"], "", ""), ("inproceedings", "Posterior  &amp; more.", ["A B 0001"], "", "https://doi.org/10.1145/1.2")]
    got = readers.index_records(spark.createDataFrame(hits, "type string, title string, authors array<string>, doi string, ee string")).collect()
    assert [(r["title"], r["authors"], r["doi"]) for r in got] == [("Posterior & more", ["A B"], "10.1145/1.2")]
    assert readers.venue_path("TWC", 2022) == "journals/twc/twc21"
    assert readers.venue_path(" NSDI ", 2024) == "conf/nsdi/nsdi2024"
    with pytest.raises(ValueError):
        readers.venue_path("unknown", 2024)
    assert readers.years("2022-2024") == [2022, 2023, 2024]


def test_sheets_and_report(spark, tmp_path):
    df = spark.createDataFrame([("T", ["A", "B"], "yes")], "title string, authors array<string>, label string")
    writers.sheet(df, str(tmp_path / "out"), ("title", "authors", "label"))
    back = readers.csv(spark, str(tmp_path / "out")).first()
    assert (back["title"], back["authors"]) == ("T", "A; B")
    counts = spark.createDataFrame([("v", "2022", 1, 0, 1)], "venue string, year string, tp int, fp int, fn int")
    assert "| v | 2022 | 1 | 0 | 1 | 0.5 |" in writers.markdown(metrics.rollup(counts), "Scores")


def test_evidence_stream(spark, tmp_path):
    claims = spark.createDataFrame([("c1", "r", 1, "doi", "x", 0.8), ("c2", "r", 1, "doi", "x", 0.8), ("c3", "r", 2, "doi", "y", 0.6)], "claim_id string, run_id string, paper_id bigint, field string, value string, confidence double")
    claims.withColumn("created_at", F.lit("2024-01-01T00:00:00Z").cast("timestamp")).write.json(str(tmp_path / "in"))
    stream = evidence.first_seen(evidence.read(spark, str(tmp_path / "in")), ["paper_id", "field"])
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2


def test_breakdown(spark):
    df = spark.createDataFrame([("v", "1", "yes", True), ("v", "1", "no", False), ("v", "2", "maybe", True)], "venue string, year string, label string, used_abstract boolean")
    got = {(r["level"], r["year"]): r for r in classify.breakdown(df, "venue", "year").collect()}
    assert (got[3, None]["total"], got[3, None]["yes_pct"], got[0, "1"]["no"]) == (3, 33.3, 1)


PROGRAM = """<h1>Proceedings of the Conference</h1><h2>Papers Info</h2><p>Day 2</p><p>09:00 — 10:20 | NetAI</p><p>Session Chair: J C</p>
<p>First: a title</p><p>A B (X); C D (Y)</p><p><a href="https://dl.acm.org/doi/10.1145/3718958.3750468"></a><a href="https://v.org/1"></a></p><p>Abstract: One.</p><p>Two.</p>
<p>Second title</p><p>E F (Z); G H (Z)</p><p><a href="https://dl.acm.org/doi/10.1145/3718958.3750472"></a></p><p>Abstract: Three.</p>"""


def test_program_pages(spark):
    from quillspark.sources import program_pages

    got = program_pages.read(spark.createDataFrame([(1, None, PROGRAM), (2, None, "<p>none</p>")], "page_id bigint, url string, html string")).orderBy("ord").collect()
    assert [(r.title, r.session, r.doi, r.abstract) for r in got] == [("First: a title", "NetAI", "10.1145/3718958.3750468", "One. Two."), ("Second title", "NetAI", "10.1145/3718958.3750472", "Three.")]


def test_paged_index(spark):
    from quillspark.sources import index_api

    def fetch(url):
        offset = int(url.split("&f=")[1].split("&")[0])
        hits = [{"info": {"type": "Conference", "title": f"Paper {k}.", "authors": {"author": {"text": "A B 0001"}}, "ee": f"https://doi.org/10.1145/{k}"}} for k in range(offset, min(150, offset + 100))]
        return {"result": {"hits": {"@total": "150", "hit": hits}}}

    got = index_api.read(spark, "imc", 2024, fetch, 0.0)
    assert got.count() == 150 and got.where("doi = '10.1145/149'").first()["authors"] == ["A B"]


def test_replies(spark):
    df = spark.createDataFrame([('```json\n{"papers": [{"title": "T", "authors": ["A", " "], "confidence": "x"}, {"title": " "}]}\n```',), ('[{"title": "U", "authors": "B", "year": "2020"}]',), ("prose",)], "reply string")
    got = sorted((r.title, r.authors, r.year, r.confidence) for r in readers.seeds_from_replies(df, "IMC", 2024).collect())
    assert got == [("T", ["A"], 2024, 0.8), ("U", ["B"], 2020, 0.8)]


def test_evaluation(spark):
    from quillspark.plans.evaluate import evaluate

    kind = "ord bigint, title string, doi string, venue string, year string"
    classified = spark.createDataFrame([(1, "Alpha paper", "10.1/a", "IMC", "2024.0", "yes"), (2, "Beta paper", "", "IMC", "2024", "no"), (3, "Other thing", "", "IMC", "2024", "yes"), (4, "X", "", "NSDI", "2024", "yes")], kind + ", label string")
    gold = spark.createDataFrame([(11, "Renamed", "https://doi.org/10.1/A", "imc", "2024"), (12, "Beta paper", "", "IMC", "2024"), (13, "Workshop", "", "IMC", "2024"), (14, "Z", "", "IMC", "2023")], kind)
    report = evaluate(classified, gold, min_gold=1)
    row = report.instances.first()
    assert (row.tp, row.fp, row.fn, row.fn_missed, row.fn_missing_from_universe) == (1, 1, 2, 1, 1)
    assert report.under_curated.first()["venue"] == "NSDI" and [tuple(r)[1:] for r in report.ignored_gold.collect()] == [("2023", 1)]
    assert sorted((r.kind, r.title) for r in report.mismatches.where("_v = 'imc'").collect()) == [("classifier_miss", "Beta paper"), ("false_positive", "Other thing"), ("missing_from_universe", "Workshop")]
    scoped = evaluate(classified, gold, drop_workshops=True, min_gold=1).rollup.where("level = 3").first()
    assert scoped.recall == 0.5
    with pytest.raises(ValueError):
        evaluate(classified.withColumn("label", F.lit(None).cast("string")), gold, drop_workshops=True)


def test_sheets_for_reconciling(spark, tmp_path):
    (tmp_path / "d.csv").write_text('Dataset Name,Bibtex Citation Key,Modality(ies)\nD,"a, b",m\n,c,\n')
    assert [(r.name, r.keys, r.modalities) for r in readers.dataset_sheet(spark, str(tmp_path / "d.csv")).collect()] == [("D", ["a", "b"], "m")]
    (tmp_path / "m.csv").write_text("Conference,Year,Workshop,Paper Title,Datasets\nimc,2023,Y,A-b!,x\nIMC,2023,,Ab,\"y, z\"\nCHI,2023,,Q,\n")
    assert [(r.title_key, r.workshop, r.datasets) for r in readers.scored_sheet(spark, str(tmp_path / "m.csv")).collect()] == [("ab", False, ["y", "z"])]
    (tmp_path / "o.json").write_text(json.dumps({"runs": [{"papers": [{"title": "T", "pdf_url": "http://x"}, {"title": "U", "pdf_url": "https://dl.acm.org/1"}]}]}))
    assert [tuple(r) for r in readers.oa_links(spark, str(tmp_path / "o.json")).collect()] == [("T", "http://x")]


def test_open_access_answers(spark):
    from quillspark.operators import enrich

    page = '<a href="/system/files/s-slides.pdf"><a href="/system/files/p.pdf">'
    answer = enrich.first_free(
        enrich.unpaywall(F.lit('{"is_oa": true, "best_oa_location": {"url": "https://dl.acm.org/x"}}')),
        enrich.openalex_access(F.lit('{"title": "Other", "open_access": {"is_oa": true, "oa_url": "http://o"}}'), F.lit("Mine")),
        enrich.usenix_access(F.lit("https://www.usenix.org/c"), F.lit(page)),
        enrich.semantic_scholar_access(F.lit('{"openAccessPdf": {"url": "http://s", "status": "GOLD"}}')),
    )
    got = spark.range(1).select(answer.alias("a")).first()["a"]
    assert (got.provider, got.pdf_url, got.status) == ("usenix", "https://www.usenix.org/system/files/p.pdf", "gold")
    feed = "<feed><entry><id>http://arxiv.org/abs/1</id><title>My\n title</title></entry></feed>"
    assert spark.range(1).select(enrich.arxiv_access(F.lit(feed), F.lit("my title")).alias("a")).first()["a"].pdf_url == "http://arxiv.org/pdf/1"
