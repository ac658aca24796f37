import csv
import glob
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.operators import extraction as X
from quillspark.operators import models
from quillspark.plans import flows

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not see the tests
KIND = "id int, ord int, title string, authors string, venue string, year int, doi string, abstract string, pdf_text string"
LONG = "word " * 60


def told(spark, *replies):
    return spark.createDataFrame([(n, r) for n, r in enumerate(replies)], "id int, reply string")


def record(**fields):
    return {"name": "Widar 3", "relationship_type": "reused", "confidence": 0.9} | fields


def test_template_fills_places_and_keeps_braces(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(X.prompt("{{{x}}} and {y}.", x=F.col("x"), y=F.col("y"))).first()[0] == "{a} and ."
    assert df.select(X.prompt("", x=F.col("x"))).first()[0] == ""
    with pytest.raises(KeyError):
        X.prompt("{z}", x=F.col("x"))


def test_records_are_typed_cleaned_and_what_does_not_fit_is_told(spark):
    good = record(name="  Widar 3 ", relationship_type="REUSED", modalities=[" csi ", "", 3, None], osi_layers=["l1", "L9"], availability="unknown", known_users=list("abcdefg"), collection_environment="Moon", confidence="0.7")
    replies = [
        "Sure:\n```json\n" + json.dumps({"datasets": [good, "x", record(name=" "), record(confidence="high"), record(name="Figure 3"), record(relationship_type="introduced", confidence=0.55), record(osi_layers="L1", availability=0)]}) + "\n```",
        "no json", '{"datasets": null}', '{"datasets": {"name": "y"}}', "[1, 2]", None, "", '{"other": 1}',
    ]
    got = sorted(X.datasets(told(spark, *replies)).collect(), key=lambda r: (r.id, r.place))
    assert [(r.id, r.place, r.name, r.relationship_type, r.confidence) for r in got] == [(0, 0, "Widar 3", "reused", 0.7), (0, 6, "Widar 3", "reused", 0.9)]
    a, b = got
    assert (a.modalities, a.osi_layers, a.availability, a.collection_environment, len(a.known_users)) == (["csi", "3"], ["L1"], True, "Real World Deployment", 5)
    assert (b.modalities, b.osi_layers, b.availability, b.availability_url) == ([], [], False, "")
    lost = {(r.id, r.place, r.reason) for r in X.quarantine(told(spark, *replies)).collect()}
    assert lost == {(0, 1, "entry"), (0, 2, "name"), (0, 3, "confidence"), (0, 6, "osi_layers"), (1, -1, "reply"), (3, -1, "datasets"), (4, -1, "reply"), (6, -1, "reply")}
    empty = spark.createDataFrame([], "id int, reply string")
    assert X.datasets(empty).count() == X.quarantine(empty).count() == 0


def test_address_from_notes(spark):
    one = spark.createDataFrame([("", None, "at https://a.org/x.), or"), ("", True, "https://a.org"), ("https://b.org", None, "https://a.org"), ("", None, "")], "availability_url string, availability boolean, availability_notes string")
    assert [r.availability_url for r in X.addresses(one).collect()] == ["https://a.org/x", "", "https://b.org", ""]


def rows(spark):
    return spark.createDataFrame(
        [(1, 1, "One", "Ann Bee", "NSDI", 2020, "10.1/a", "abstract one", LONG), (2, 2, "Two", "Ann Bee", "NSDI", 2020, None, "same abstract", "short"), (3, 3, "Two", "Ann Bee", "NSDI", 2020, None, "same abstract", None), (4, 4, "Four", None, None, None, None, " ", None), (5, 5, "Bad", "", "NSDI", 2021, "", "broken", None)], KIND,
    )


def test_attempts_are_made_in_order_and_equal_prompts_asked_once(spark, tmp_path):
    log, folder = tmp_path / "log", f"file://{tmp_path}/run"
    log.mkdir()

    def ask(prompt):
        with open(glob.escape(str(log)) + "/" + X.__name__ + str(abs(hash(prompt))), "a") as f:
            f.write("x")
        if "broken" in prompt:
            raise RuntimeError("down")
        return json.dumps({"datasets": [record(name="Set of " + prompt.split("Title: ")[1].split("\n")[0])]})

    papers = rows(spark)
    got, asked = X.replies(papers, X.attempts(), ask=models.replies(ask), folder=folder)
    assert {r.id: (r.extraction_source, r.error) for r in got.collect()} == {1: ("pdf_text_fallback", None), 2: ("abstract", None), 3: ("abstract", None), 4: ("title_only", None), 5: ("abstract", "down")}
    files = list(log.iterdir())
    assert len(files) == 4 and all(f.read_text() == "x" for f in files)
    assert asked.count() == 3  # what failed is not put into the cache
    again, _ = X.replies(papers, X.attempts(), ask=models.replies(ask), folder=folder)
    assert again.count() == 5 and all(f.read_text() == "x" for f in log.iterdir())
    fresh, more = X.replies(papers, X.attempts(), cache=asked, ask=models.replies(ask))
    assert more.count() == 0 and fresh.where("reply IS NOT NULL").count() == 4  # only the one that failed was asked again
    assert sorted(len(f.read_text()) for f in log.iterdir()) == [1, 1, 1, 2]


def test_next_attempt_follows_a_reply_without_an_object(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    tries = [("first", F.concat(F.lit("a"), F.col("id").cast("string"))), ("second", F.when(F.col("id") < 3, F.concat(F.lit("b"), F.col("id").cast("string"))))]
    cache = df.sparkSession.createDataFrame([("a1", "sorry"), ("b1", "{}"), ("a2", '{"datasets": []}'), ("b2", "{}"), ("a3", "[]")], "p string, reply string").select(X.key(F.col("p")).alias("key"), "reply")
    got, _ = X.replies(df, tries, cache)
    assert sorted(tuple(r)[:2] + (r.error,) for r in got.collect()) == [(1, "second", None), (2, "first", None), (3, "first", "reply is no JSON object")]
    with pytest.raises(ValueError):
        X.replies(df, tries)


def test_flow_writes_the_sheets(spark, tmp_path):
    papers = rows(spark)
    reply = F.to_json(F.struct(F.array(F.struct(F.lit("Widar 3").alias("name"), F.when(F.col("id") == 2, "introduced").otherwise("reused").alias("relationship_type"), F.lit(0.9).alias("confidence"), F.lit("https://w.org").alias("availability_url"))).alias("datasets")))
    cache = papers.select(X.key(F.coalesce(*(p for _, p in X.attempts()))).alias("key"), reply.alias("reply"))
    labels = spark.createDataFrame([(1, "yes"), (2, "maybe"), (3, "no")], "id int, label string")
    done = flows.extract(papers, cache, labels=labels, live=lambda df: df.withColumn("live", F.lit(False)), entries=spark.createDataFrame([(1, "@article{x, title = {One}}"), (2, "none")], "id int, bibtex string"), folder=str(tmp_path), slug="nsdi_2020")
    by = {r.id: r for r in done.papers.collect()}
    assert sorted(by) == [1, 2, 4, 5] and by[1].bibtex == "@article{bee2020one, title = {One}}" and by[2].bibtex.startswith("@inproceedings{bee2020two,")
    assert [d.usage_count for d in by[1].datasets] == [2] and by[1].datasets[0].availability is False

    def sheet(name):
        return [r for f in sorted(glob.glob(f"{tmp_path}/nsdi_2020_{name}.csv/*.csv")) for r in csv.DictReader(open(f, newline=""))]

    assert [(r["Dataset Name"], r["Bibtex Citation Key"], r["Availability (Open? Y/N)"], r["Number of Papers using Dataset"]) for r in sheet("datasets")] == [("Widar 3", "bee2020two", "N", "2")]
    assert len(sheet("papers")) == len(sheet("bibtex")) == 4
    none = flows.extract(papers.limit(0), cache)
    assert none.papers.count() == none.datasets.count() == none.rejected.count() == 0
