"""A paged publication index as a Spark data source; one partition for each page of hits."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillspark.sources import readers

PAGE = 100
URL = "https://dblp.org/search/publ/api?q=toc%3Adb/{key}.bht%3A&h={page}&f={offset}&format=json"
KIND = "ord int, type string, title string, authors array<string>, doi string, ee string, year string"


def _get(url: str) -> dict:
    with urlopen(url, timeout=30) as answer:
        return json.load(answer)


def _several(x) -> list:
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, key: str, fetch: Callable[[str], dict], pause: float):
        self.key, self.fetch, self.pause = key, fetch, pause

    def _hits(self, number: int) -> tuple[int, list]:
        found = self.fetch(URL.format(key=self.key, page=PAGE, offset=number * PAGE)).get("result", {}).get("hits", {})
        return int(found.get("@total", 0) or 0), _several(found.get("hit"))

    def partitions(self):
        return [_Page(k) for k in range(max(1, -(-self._hits(0)[0] // PAGE)))]

    def read(self, partition):
        if partition.number:
            time.sleep(self.pause)
        for n, hit in enumerate(self._hits(partition.number)[1]):
            info = hit.get("info") or {}
            names = [a.get("text", "") if isinstance(a, dict) else str(a) for a in _several((info.get("authors") or {}).get("author"))]
            text = lambda k: info[k] if isinstance(info.get(k), str) else None
            yield partition.number * PAGE + n, text("type"), text("title"), [a for a in names if a], text("doi"), text("ee"), text("year")


class _Part(_Page):
    """Records from ``low`` to below ``high`` of a page."""

    def __init__(self, number: int, low: int, high: int):
        super().__init__(number)
        self.low, self.high = low, high


class _Pages(DataSourceStreamReader):
    """The index as a stream: an offset is the number of records that have been read.

    Each batch reads up to ``most`` pages, a partition each.  How many records there are is asked when
    a batch is planned, so those that come in later are read later, the rest of a page too.
    """

    def __init__(self, reader: _Reader, most: int):
        self.reader, self.most, self.seen = reader, most, 0

    def initialOffset(self) -> dict:
        return {"record": 0}

    def latestOffset(self) -> dict:
        page = min(self.seen // PAGE + self.most, 1 << 40)
        self.seen = max(self.seen, min(self.reader._hits(0)[0], page * PAGE))
        return {"record": self.seen}

    def partitions(self, start: dict, end: dict):
        a, b = start["record"], end["record"]
        self.seen = max(self.seen, b)  # after a restart the last batch is planned again first
        return [_Part(k, max(a - k * PAGE, 0), min(b - k * PAGE, PAGE)) for k in range(a // PAGE, -(-b // PAGE))]

    def read(self, partition):
        base = partition.number * PAGE
        return (hit for hit in self.reader.read(partition) if partition.low <= hit[0] - base < partition.high)

    def commit(self, end: dict) -> None:
        self.seen = max(self.seen, end["record"])


def source(fetch: Callable[[str], dict] = _get, pause: float = 3.0) -> type[DataSource]:
    """The data source class for a fetch function; register it, or use ``read``."""

    class Index(DataSource):
        @classmethod
        def name(cls):
            return "publication_index"

        def schema(self):
            return KIND

        def reader(self, schema):
            return _Reader(self.options["key"], fetch, pause)

        def streamReader(self, schema):
            return _Pages(self.reader(schema), int(self.options.get("pagesPerBatch", "10")))

    return Index


def read(spark: SparkSession, venue: str, year: int, fetch: Callable[[str], dict] = _get, pause: float = 3.0) -> DataFrame:
    """Papers of a venue's year, without editors' and other records that are no papers."""
    spark.dataSource.register(source(fetch, pause))
    hits = spark.read.format("publication_index").option("key", readers.venue_path(venue, year)).load()
    return readers.index_records(hits)


def stream(spark: SparkSession, venue: str, year: int, fetch: Callable[[str], dict] = _get, pause: float = 3.0, pages: int = 10) -> DataFrame:
    """The hits of a venue's year as a stream of ``pages`` pages a batch, to be given to
    ``readers.index_records``; a query that stopped goes on after the last record of its last batch."""
    spark.dataSource.register(source(fetch, pause))
    options = {"key": readers.venue_path(venue, year), "pagesPerBatch": str(pages)}
    return spark.readStream.format("publication_index").options(**options).load()
