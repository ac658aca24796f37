import json
import os

import pytest

from quillspark.operators import enrich
from quillspark.sources import versions
from quillspark.streaming import evidence

KIND = "key string, n int, value string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    make = lambda data: spark.createDataFrame(data, KIND)
    assert versions.upsert(make([(f"k{n}", 1, "a") for n in range(40)] + [("k1", 2, "b"), (None, 1, "null")]), path, ["key"], "n", 0, buckets=8)
    before = versions._manifest(spark, path)["folders"]
    assert versions.upsert(make([("k3", 1, "new"), ("z", 5, "z")]), path, ["key"], "n", 1)
    after = versions._manifest(spark, path)["folders"]
    assert 1 <= sum(before[k] != after[k] for k in before) <= 2
    got = {r.key: r.value for r in versions.read(spark, path).collect()}
    assert len(got) == 42 and got["k1"] == "b" and got["k3"] == "new" and got[None] == "null" and versions.read(spark, path).count() == 42
    assert not versions.upsert(make([("k3", 9, "again")]), path, ["key"], "n", 1)
    assert versions.upsert(make([]), path, ["key"], "n", 2) and versions.read(spark, path).count() == 42
    for n in range(3, 5):
        versions.upsert(make([(f"k{k}", n, "c") for k in range(40)] + [("z", n, "c"), (None, n, "c")]), path, ["key"], "n", n)
    last = versions.read(spark, path)
    assert rows(last.where("key IS NOT NULL").groupBy("value").count()) == [("c", 41)] and rows(last.where("key IS NULL").select("n")) == [(1,), (3,), (4,)]
    assert versions.vacuum(spark, path) == 3 and versions.read(spark, path).count() == 44


def test_a_change_that_fails_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert(spark.createDataFrame([("a", 1, "x")], KIND), path, ["key"], "n")
    bad = spark.createDataFrame([("a", 2, "y")], KIND).selectExpr("key", "n", "CASE WHEN n = 2 THEN raise_error('no') ELSE value END AS value")
    with pytest.raises(Exception, match="no"):
        versions.upsert(bad, path, ["key"], "n")
    assert rows(versions.read(spark, path)) == [("a", 1, "x")]


def test_a_stream_resumes_where_it_stopped(spark, tmp_path):
    source, path, mark = (str(tmp_path / n) for n in ("in", "t", "mark"))
    os.makedirs(source)
    put = lambda name, data: (tmp_path / "in" / name).write_text("\n".join(json.dumps(d) for d in data))

    def run():
        claims = evidence.read(spark, source, KIND, files_per_trigger=1)
        evidence.merged(claims, path, ["key"], "n", mark, buckets=4).awaitTermination(120)

    put("1.json", [{"key": "a", "n": 1, "value": "x"}, {"key": "b", "n": 1, "value": "y"}])
    put("2.json", [{"key": "a", "n": 2, "value": "z"}])
    run()
    first = rows(versions.read(spark, path).where("key = 'b'"))
    put("3.json", [{"key": "b", "n": 3, "value": "w"}])
    run()
    got = {r.key: r.value for r in versions.read(spark, path).collect()}
    assert first == [("b", 1, "y")] and set(got) == {"a", "b"} and got["b"] == "w"


def test_live_addresses(spark):
    def head(at):
        if at.endswith("refuse"):
            raise OSError
        return 405 if at.endswith("get") else 404 if at.endswith("gone") else 200

    def get(at):
        return 404 if at.endswith("gone") else 200

    data = [(1, "http://a/ok", None), (2, " http://a/get ", False), (3, "http://a/gone", True), (4, "", True), (5, None, None), (6, "http://a/refuse", False), (7, "http://a/ok", False)]
    df = spark.createDataFrame(data, "id int, url string, availability boolean")
    told = enrich.live(df, "id", "url", head, get)
    assert {r.id for r in told.where("live").collect()} == {1, 2, 6, 7} and told.count() == 7
    some = enrich.available(df, "id", told.where("id < 4"))
    assert {r.id: r.availability for r in some.collect()} == {1: True, 2: True, 3: False, 4: True, 5: None, 6: False, 7: False}


def test_citations_are_found_or_made(spark):
    def fetch(dois):
        return ["@article{theirs, title={T}}" if d == "10.1/a" else "<html>" if d == "10.1/b" else None for d in dois]

    data = [(1, "10.1/a", "k1"), (2, "10.1/b", "k2"), (3, None, "k3"), (4, " 10.1/a ", "k4")]
    papers = spark.createDataFrame([(i, d, k, "T", "A; B", 2023, "V") for i, d, k in data], "id int, doi string, bibtex_key string, title string, authors string, year int, venue string")
    got = {r.id: r.bibtex for r in enrich.citations(papers, "id", fetch).collect()}
    assert got[1] == "@article{k1, title={T}}" and got[4] == "@article{k4, title={T}}"
    assert got[2].startswith("@inproceedings{k2,") and "10.1/b" in got[2] and got[3].startswith("@inproceedings{k3,") and "doi" not in got[3] and len(got) == 4
