import json
import os
import re

from quillspark.sources import index_api, readers


def make_fetch(folder):
    """An index of ``total`` records in a file, whose requests are told in another."""

    def fetch(url):
        offset = int(re.search(r"[?&]f=(\d+)", url).group(1))
        total = int((folder / "total").read_text())
        with open(folder / f"asked-{os.getpid()}", "a") as f:
            f.write(f"{offset}\n")
        hits = [{"info": {"type": "Conference and Workshop Papers", "title": f"T{n}", "authors": {"author": [{"text": "A"}]}, "year": "2023"}} for n in range(offset, min(total, offset + index_api.PAGE))]
        return json.loads(json.dumps({"result": {"hits": {"@total": str(total), "hit": hits}}}))

    return fetch


def asked(folder):
    return [int(x) for f in folder.glob("asked-*") for x in f.read_text().split()]


def test_a_stream_goes_on_with_the_next_page(spark, tmp_path):
    fetch, out, mark = make_fetch(tmp_path), str(tmp_path / "out"), str(tmp_path / "mark")
    venue = "NSDI"

    def run(total, batches=None):
        (tmp_path / "total").write_text(str(total))
        for f in tmp_path.glob("asked-*"):
            f.unlink()
        stream = index_api.stream(spark, venue, 2023, fetch, 0.0, pages=1)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(processingTime="0 seconds").start()
        try:
            while batches is None and query.isActive or batches and query.lastProgress is None or batches and (query.lastProgress or {}).get("batchId", -1) < batches - 1:
                query.awaitTermination(0.2)
                if batches is None and (query.lastProgress or {}).get("numInputRows") == 0:
                    break
        finally:
            query.stop()
        return sorted(r.title for r in spark.read.parquet(out).collect())

    first = run(430, batches=3)
    pages = len(first) // 100
    assert pages >= 3 and first == sorted(f"T{n}" for n in range(len(first)))
    rest = run(430)
    assert not {100 * k for k in range(1, pages)} & set(asked(tmp_path))  # pages that were read are not asked for again
    batch = spark.read.format("publication_index").option("key", readers.venue_path(venue, 2023)).load()
    assert rest == sorted(r.title for r in batch.collect()) and len(rest) == 430
    grown = run(530)
    assert grown == sorted(f"T{n}" for n in range(530)), len(grown)
    assert not {100, 200, 300} & set(asked(tmp_path))
