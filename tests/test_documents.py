import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources import documents as D


def same(path, want):
    got = open(path, encoding="utf-8").read()
    assert got == json.dumps(want, indent=2, ensure_ascii=False)
    assert os.listdir(os.path.dirname(path)) == [os.path.basename(path)]  # nothing is left beside it


PAPERS = [("NSDI", 2021, 3, "ünï", ["a"]), ("NSDI", 2021, 1, 'q"\n', []), ("IMC", None, 2, None, None), ("NSDI", 2020, 9, "x", ["a", "b"]), (None, 2020, 4, "y", [])]


def test_runs_of_many_tasks_are_one_document(spark, tmp_path):
    papers = spark.createDataFrame(PAPERS, "venue string, year int, ord int, title string, names array<string>").repartition(4)
    path = f"{tmp_path}/o/runs.json"
    os.mkdir(f"{tmp_path}/o")
    D.runs(papers, path, {"venue": "NSDI", "years": [2020, 2021]})
    paper = lambda v, y, t, n: {"venue": v, "year": y, "title": t, "names": n}
    run = lambda v, y, *ps: {"venue": v, "year": y, "total_papers": len(ps), "papers": [paper(v, y, *p) for p in ps]}
    want = {"venue": "NSDI", "years": [2020, 2021], "runs": [run(None, 2020, ("y", [])), run("IMC", None, (None, None)), run("NSDI", 2020, ("x", ["a", "b"])), run("NSDI", 2021, ('q"\n', []), ("ünï", ["a"]))]}
    same(path, want)
    D.runs(papers.limit(0), f"{tmp_path}/o/runs.json", {})
    same(path, {"runs": []})


def test_lists_sections_and_odd_names(spark, tmp_path):
    os.mkdir(f"{tmp_path}/o")
    path = f"file://{tmp_path}/o/d.json"
    rows = spark.range(500).select(F.col("id").alias("n"), F.struct(F.lit(None).cast("string").alias("x"), F.array("id").alias("kind")).alias("value"))
    D.listed(rows.repartition(7), path, {"total": 500}, "matches", [F.desc("n")])
    same(f"{tmp_path}/o/d.json", {"total": 500, "matches": [{"n": n, "value": {"x": None, "kind": [n]}} for n in range(499, -1, -1)]})
    cache = spark.createDataFrame([("llm", "b", '{"z": 1}'), ("llm", 'a"', "[]"), ("llm", "b", '{"z": 1}'), ("dois", "k", '"v"')], "section string, key string, value string")
    D.members(cache, path, ["oa", "llm", "dois"])
    same(f"{tmp_path}/o/d.json", {"dois": {"k": "v"}, "llm": {'a"': [], "b": {"z": 1}}, "oa": {}})
    D.members(cache.limit(0), path, [])
    same(f"{tmp_path}/o/d.json", {})
    with pytest.raises(ValueError):
        D.members(cache, path, ["llm"])


def test_equal_content_stays_and_a_failing_task_leaves_the_old_file(spark, tmp_path):
    os.mkdir(f"{tmp_path}/o")
    path = f"{tmp_path}/o/s.csv"
    rows = spark.createDataFrame([(2, 'a,"b"', ["x", "y"]), (1, None, []), (3, "l\nm", None)], "n int, t string, l array<string>")
    D.sheet(rows, path, [F.col("n")])
    want = io.StringIO(newline="")
    csv.writer(want).writerows([("n", "t", "l"), ("1", "", ""), ("2", 'a,"b"', "x; y"), ("3", "l\nm", "")])
    assert open(path, newline="").read() == want.getvalue()
    os.utime(path, (1, 1))
    D.sheet(rows.repartition(3), path, [F.col("n")])
    assert os.stat(path).st_mtime == 1
    broken = spark.range(1000).select(F.when(F.col("id") == 990, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("n"))
    with pytest.raises(Exception, match="no"):
        D._save(broken, path, kind="csv")
    assert os.stat(path).st_mtime == 1 and os.listdir(f"{tmp_path}/o") == ["s.csv"]
    D.sheet(rows.where("n = 2"), path, [F.col("n")])
    assert os.stat(path).st_mtime > 1 and len(open(path).readlines()) == 2
