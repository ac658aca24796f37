import json
import threading

import pytest

from quillspark.sources import shared, versions as V
from quillspark.streaming import evidence

KIND = "key string, n int, value string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def make(spark):
    return lambda *data: spark.createDataFrame(list(data), KIND)


def test_a_second_stream_counts_its_own_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    for stream in ("a", "b"):
        source = tmp_path / f"in-{stream}"
        source.mkdir()
        (source / "1.json").write_text(json.dumps({"key": stream, "n": 1, "value": stream}))
        for checkpoint in ("first", "again"):
            if checkpoint == "again":
                (source / "2.json").write_text(json.dumps({"key": stream, "n": 2, "value": "later"}))
            claims = evidence.read(spark, str(source), KIND)
            evidence.merged(claims, path, ["key"], "n", str(tmp_path / f"mark-{stream}-{checkpoint}"), buckets=4).awaitTermination(120)
    assert rows(V.read(spark, path)) == [("a", 2, "later"), ("b", 2, "later")]
    assert len(V._last(spark, path)[1]["writers"]) == 4


def test_a_batch_is_made_once_for_each_writer(spark, tmp_path, make):
    path = str(tmp_path / "t")
    assert V.upsert(make(("a", 1, "x")), path, ["key"], "n", 0, writer="one")
    assert not V.upsert(make(("a", 2, "y")), path, ["key"], "n", 0, writer="one")
    assert V.upsert(make(("b", 1, "z")), path, ["key"], "n", 0, writer="two")
    assert rows(V.read(spark, path)) == [("a", 1, "x"), ("b", 1, "z")]


def test_writers_that_overlap_both_survive(spark, tmp_path, make):
    """The second one found the store before the first one's entry, in other buckets and in the same."""
    path = str(tmp_path / "t")
    V.upsert(make(*((f"k{n}", 0, "old") for n in range(30))), path, ["key"], "n", buckets=16)
    place = {r.key: r.b for r in V.read(spark, path).selectExpr("key", "pmod(xxhash64(key), 16) AS b").collect()}
    other = next(k for k in place if place[k] != place["k0"])
    same = next(k for k in place if place[k] == place["k0"] and k != "k0")
    first, second = V.Change(spark, path), V.Change(spark, path)
    first.upsert(V.ONE, make(("k0", 1, "first")), ["key"], "n")
    second.upsert(V.ONE, make((other, 1, "second")), ["key"], "n")
    assert first.commit() + 1 == second.commit()
    third, fourth = V.Change(spark, path), V.Change(spark, path)
    third.upsert(V.ONE, make(("k0", 2, "third")), ["key"], "n")
    fourth.upsert(V.ONE, make((same, 2, "fourth")), ["key"], "n")
    third.commit()
    with pytest.raises(V.Conflict):
        fourth.commit()
    seen = []

    def late(c):
        if not seen:  # another change comes in between, once
            V.upsert(make(("k0", 3, "between")), path, ["key"], "n")
        seen.append(c.base)
        c.upsert(V.ONE, make((same, 3, "late")), ["key"], "n")

    assert V.change(spark, path, late) and len(seen) == 2
    got = {r.key: r.value for r in V.read(spark, path).collect()}
    assert len(got) == 30 and got["k0"] == "between" and got[other] == "second" and got[same] == "late"


def test_many_writers_at_once(spark, tmp_path, make):
    path, failed = str(tmp_path / "t"), []

    def work(k):
        try:
            for n in range(2):
                V.upsert(make((f"own{k}", n, str(n)), ("shared", 10 * k + n, str(k))), path, ["key"], "n", n, buckets=2, writer=str(k))
        except Exception as e:  # told to the test's thread
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not failed and V.version(spark, path) == 7
    assert {r.key for r in V.read(spark, path).collect()} == {"shared", *(f"own{k}" for k in range(4))}


def test_tables_change_together_or_not_at_all(spark, tmp_path, make):
    path = str(tmp_path / "store")

    def both(c):
        c.upsert("papers", make(("p", 1, "x"), ("q", 1, "x")), ["key"], "n", 4)
        c.upsert("venues", make(("v", 1, "x")), ["key"], "n", 4)

    assert V.change(spark, path, both) and V.tables(spark, path) == ["papers", "venues"]

    def dies(c):
        c.upsert("papers", make(("p", 2, "lost")), ["key"], "n")
        c.remove("venues", make(("v", 0, "")), ["key"])
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        V.change(spark, path, dies)
    crash = V.Change(spark, path)  # a driver that is gone leaves folders behind, and no entry
    crash.upsert("papers", make(("p", 3, "lost")), ["key"], "n")
    now = V.snapshot(spark, path)
    assert rows(now["papers"]) == [("p", 1, "x"), ("q", 1, "x")] and rows(now["venues"]) == [("v", 1, "x")]
    assert V.vacuum(spark, path) == 1 and V.version(spark, path) == 0

    def prune(c):
        c.remove("papers", c.read("papers").where("key = 'q'"), ["key"])
        c.remove("venues", make(("none", 0, ""), (None, 0, "")), ["key"])

    assert V.change(spark, path, prune)
    assert rows(V.snapshot(spark, path)["papers"]) == [("p", 1, "x")] and rows(V.snapshot(spark, path)["venues"]) == [("v", 1, "x")]
    assert rows(V.snapshot(spark, path, at=0)["papers"]) == [("p", 1, "x"), ("q", 1, "x")]
    with pytest.raises(FileNotFoundError):
        V.snapshot(spark, path, at=9)


def test_what_a_change_read_may_not_change_under_it(spark, tmp_path, make):
    path = str(tmp_path / "store")
    V.change(spark, path, lambda c: (c.upsert("a", make(("x", 1, "1")), ["key"], "n", 2), c.upsert("b", make(("y", 1, "1")), ["key"], "n", 2)))
    reader, writer = V.Change(spark, path), V.Change(spark, path)
    reader.upsert("b", reader.read("a"), ["key"], "n")
    writer.upsert("a", make(("z", 1, "1")), ["key"], "n")
    writer.commit()
    with pytest.raises(V.Conflict):
        reader.commit()
    one, two = V.Change(spark, path), V.Change(spark, path)  # both make a table of one name
    one.upsert("new", make(("x", 1, "1")), ["key"], "n")
    two.upsert("new", make(("z", 1, "1")), ["key"], "n")
    one.commit()
    with pytest.raises(V.Conflict):
        two.commit()


def test_rows_are_evaluated_once(spark, tmp_path, make):
    path, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    V.upsert(make(("a", 1, "x")), path, ["key"], "n", buckets=1)
    V.upsert(make(("a", 2, "y"), ("b", 1, "z")).mapInPandas(count, KIND), path, ["key"], "n")
    assert seen.value == 2 and rows(V.read(spark, path)) == [("a", 2, "y"), ("b", 1, "z")]


def test_a_file_is_made_once(spark, tmp_path):
    at = f"file://{tmp_path}/d/x.json"
    assert shared.put(spark, at, "1é") and not shared.put(spark, at, "2") and shared.text(spark, at) == "1é"
    assert shared.put(spark, at, "3", replace=True) and shared.text(spark, at) == "3"
    assert [n for n in shared.names(spark, f"{tmp_path}/d") if n[0] != "."] == ["x.json"]
    assert shared.names(spark, f"{tmp_path}/none") == []
