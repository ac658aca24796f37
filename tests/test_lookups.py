import json

from quillspark.streaming import lookups as L


def test_a_miss_is_asked_again_after_its_time_and_across_a_restart(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    number = iter(range(100))

    def run(*events):
        text = "\n".join(json.dumps(dict(zip(("key", "day", "kind", "value"), e)) | {"at": int((1000 + e[1]) * L.DAY)}) for e in events)
        (source / f"{next(number):03d}.json").write_text(text)
        L.written(L.remembered(L.read(spark, str(source), 1)), out, mark).awaitTermination(180)
        return sorted((r.key, r.at // L.DAY - 1000, r.action, r.value) for r in spark.read.schema(L.OUT).parquet(out).collect())

    first = run(("a", 0, "request"), ("a", 1, "answer", None), ("a", 10, "request"), ("b", 0, "request"), ("b", 2, "answer", "B"), (None, 3, "request"), ("c", 5, "request"), ("c", 5, "request"))
    assert first == [("a", 0, "ask", None), ("a", 10, "miss", None), ("b", 0, "ask", None), ("c", 5, "ask", None), ("c", 5, "open", None)]
    # each run starts a new query on the checkpoint
    second = run(("a", 30, "request"), ("a", 32, "request"), ("b", 90, "request"), ("d", 90, "request"))
    assert sorted(set(second) - set(first)) == [("a", 30, "miss", None), ("a", 32, "ask", None), ("b", 90, "found", "B"), ("d", 90, "ask", None)]
    third = run(("c", 91, "request"), ("b", 200, "request"))
    assert sorted(set(third) - set(second)) == [("b", 200, "found", "B"), ("c", 91, "ask", None)] and len(third) == len(second) + 2
