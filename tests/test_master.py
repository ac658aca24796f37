import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import master, records
from quillspark.sources import versions

R, S = "run string, paper int, ord int, name string", "run string, ord int, name string, key string, number string"


def run_of(spark, data, kinds):
    return spark.createDataFrame(data, kinds)


def made(name, seed):
    """A run: records of papers, and its sheet."""
    draw = random.Random(seed)
    rows = [(name, draw.randrange(4), n, draw.choice(["Widar", "widar dataset", "Widar  Traces", "MNIST", "Ookla data", "Ookla", f"only {name}"])) for n in range(draw.randrange(1, 12))]
    names = list(dict.fromkeys(r[3] for r in rows))
    return rows, [(name, n, x, draw.choice(["", "k1", "k2", None]), draw.choice(["1", "2", "x", None])) for n, x in enumerate(names)]


def whole(spark, runs):
    """All merged anew; runs follow each other by name."""
    recs, sheets = [r for n in sorted(runs) for r in runs[n][0]], [s for n in sorted(runs) for s in runs[n][1]]
    many = lambda rows: [(n, *r) for n, r in enumerate(rows)]
    r = run_of(spark, [(n, f"{run} {p}", x) for n, run, p, _, x in many(recs)], "ord int, paper string, name string")
    s = run_of(spark, [(n, x, k, v) for n, _, _, x, k, v in many(sheets)], "ord int, name string, key string, number string")
    return sorted(map(tuple, records.merge_sheets(s, records.corpus_counts(r)).collect()))


def put(spark, path, names, runs):
    recs, sheets = [r for n in names for r in runs.get(n, ([], []))[0]], [s for n in names for s in runs.get(n, ([], []))[1]]
    return master.replace(spark, path, run_of(spark, [(n,) for n in names], "run string"), run_of(spark, recs, R), run_of(spark, sheets, S), 8)


def test_runs_added_made_again_and_dropped_equal_a_merge_of_all(spark, tmp_path):
    path, runs = f"file://{tmp_path}/m", {}
    for names, seed in ((["b_2020", "a_2021"], 1), (["c_2019"], 2), (["b_2020"], 3), (["a_2021", "d_2022"], 4)):
        runs |= {n: made(n, seed * 100 + k) for k, n in enumerate(names)}
        put(spark, path, names, runs)
        assert sorted(map(tuple, master.merged(spark, path).collect())) == whole(spark, runs)
    del runs["c_2019"]
    before = versions.version(spark, path)
    put(spark, path, ["c_2019"], {})
    assert versions.version(spark, path) == before + 1
    assert sorted(map(tuple, master.merged(spark, path).collect())) == whole(spark, runs)
    assert all(r.papers >= 2 for r in master.merged(spark, path, 2).collect())


def test_a_run_touches_its_own_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    many = [(f"r{n}", n, n, f"name {n}") for n in range(40)]
    put(spark, path, [r[0] for r in many], {r[0]: ([r], []) for r in many})
    was = versions._last(spark, path)[1]["tables"]["names"]["folders"]
    touched = put(spark, path, ["r7"], {"r7": ([("r7", 1, 1, "name 8")], [("r7", 1, "name 8", "k", "5")])})
    now = versions._last(spark, path)[1]["tables"]["names"]["folders"]
    assert 1 <= len(touched) <= 2 and {k for k in was if was[k] != now.get(k)} <= {str(k) for k in touched}
    got = {r.name: (r.key, r.summed, r.papers) for r in master.merged(spark, path).collect()}
    assert "name 7" not in got and got["name 8"] == ("k", 5, 2) and len(got) == 39


def test_blank_null_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    put(spark, path, ["x"], {"x": ([("x", 1, 0, " "), ("x", 1, 1, None), ("x", None, 2, "Set")], [("x", 0, None, "k", "1"), ("x", 1, "Lone", None, "3")])})
    assert sorted(map(tuple, master.merged(spark, path).collect())) == [("Lone", "", 3, 1), ("Set", "", None, 1)]
    put(spark, path, [], {})
    assert master.merged(spark, path).count() == 2
