"""Tables of Parquet folders that are changed bucket by bucket, several of them in one step.

A store is a folder with a log of numbered entries.  An entry names, for each table, its columns, its
number of buckets and the folder that holds each bucket's rows; it also names the buckets that its
change touched, and the last batch of each writer.  A change writes new folders first and its entry
last, and makes the entry only if there is none of that number.  So a reader sees all of a change or
nothing of it, in all tables, and a change that fails or dies leaves the store as it was.

Of two changes that overlap, the later one reads the entries that came in between.  If they touched
other buckets than those that it read or wrote, its own folders are put into the newer state; else it
is made anew from there.  Entries have ``buckets`` folders a table at most, whatever its size.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import shared

BUCKETS = 256
TRIES = 20
WHOLE = -1  # in the place of a bucket: all of a table
_EMPTY = {"tables": {}, "writers": {}, "touched": {}}


class Conflict(RuntimeError):
    """Another change of the same rows came first."""


def _entry(path: str, number: int) -> str:
    return f"{path}/log/{number:020d}.json"


def _last(spark: SparkSession, path: str, at: int | None = None) -> tuple[int, dict]:
    """(number, state) of the newest entry, or of entry ``at``; number -1 of a store without any."""
    found = [int(n[:-5]) for n in shared.names(spark, f"{path}/log") if n.endswith(".json") and n[0] != "."]
    if at is not None and at not in found:
        raise FileNotFoundError(_entry(path, at))
    if not found:
        return -1, _EMPTY
    number = max(found) if at is None else at
    return number, json.loads(shared.text(spark, _entry(path, number)))


def _rows(spark: SparkSession, path: str, table: dict, buckets: list[int] | None = None) -> DataFrame:
    parts = [f"{path}/{folder}/_bucket={k}" for k, folder in table["folders"].items() if buckets is None or int(k) in buckets]
    reader = spark.read.schema(table["schema"])
    return reader.parquet(*parts) if parts else spark.createDataFrame([], table["schema"])


class Change:
    """A change of one or more tables of a store, from the state that it found."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.base, self.found = _last(spark, path)
        self.tables = json.loads(json.dumps(self.found["tables"]))
        self.read_of: dict[str, set[int]] = {}
        self.touched: dict[str, set[int]] = {}
        self.made: list[str] = []

    def has(self, name: str) -> bool:
        self.read_of.setdefault(name, set())
        return name in self.tables

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as this change would leave it so far; what it reads may not change under it."""
        if name not in self.tables:
            raise FileNotFoundError(f"{self.path}: {name}")
        self.read_of.setdefault(name, set()).update([WHOLE] if buckets is None else buckets)
        return _rows(self.spark, self.path, self.tables[name], buckets)

    def done(self, writer: str, batch: int) -> bool:
        last = self.found["writers"].get(writer)
        return last is not None and batch <= last

    def _folder(self) -> str:
        self.made.append(f"change-{uuid.uuid4().hex}")
        return self.made[-1]

    def _written(self, rows: DataFrame, keys: list[str], table: dict) -> tuple[str, list[int]]:
        """Writes rows by bucket; the folder and the buckets that it has."""
        if "_bucket" in (c.lower() for c in rows.columns):
            raise ValueError("_bucket is no name for a column")
        folder = self._folder()
        place = F.pmod(F.xxhash64(*keys), F.lit(table["buckets"])).cast("int")
        rows.withColumn("_bucket", place).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder, [int(n.split("=")[1]) for n in shared.names(self.spark, f"{self.path}/{folder}") if n.startswith("_bucket=")]

    def _drop(self, folder: str) -> None:
        shared.remove(self.spark, f"{self.path}/{folder}")
        self.made.remove(folder)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
        """Puts rows in the place of those with their key; of equal keys the last by ``order`` counts.

        A null in a key equals no key that the table has, as in SQL, so such a row replaces none.  The
        first rows of a table fix its columns and its number of buckets.  ``rows`` is evaluated once.
        """
        if name not in self.tables:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            self.tables[name] = {"schema": schema, "buckets": buckets, "folders": {}}
            self.touched.setdefault(name, set()).add(WHOLE)
        table = self.tables[name]
        columns = self.spark.createDataFrame([], table["schema"]).columns
        one = rows.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(c) for c in columns)), F.struct(order)).alias("_row")).select("_row.*")
        folder, touched = self._written(one, keys, table)
        old = [k for k in touched if str(k) in table["folders"]]
        if old:
            new = self.spark.read.schema(table["schema"]).parquet(*(f"{self.path}/{folder}/_bucket={k}" for k in touched))
            kept = _rows(self.spark, self.path, table, old).join(new.select(*keys), keys, "left_anti")
            both = self._written(kept.select(*columns).unionByName(new), keys, table)[0]
            self._drop(folder)
            folder = both
        elif not touched:
            self._drop(folder)
        table["folders"] |= {str(k): folder for k in touched}
        self.touched.setdefault(name, set()).update(touched)

    def remove(self, name: str, doomed: DataFrame, keys: list[str]) -> None:
        """Takes out the rows with these keys."""
        table = self.tables[name]
        folder, touched = self._written(doomed.select(*keys).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).distinct(), keys, table)
        old = [k for k in touched if str(k) in table["folders"]]
        if old:
            gone = self.spark.read.schema(doomed.select(*keys).schema).parquet(*(f"{self.path}/{folder}/_bucket={k}" for k in old))
            kept = _rows(self.spark, self.path, table, old).join(gone, keys, "left_anti")
            left, having = self._written(kept, keys, table)
            for k in old:
                del table["folders"][str(k)]
            table["folders"] |= {str(k): left for k in having}
        self._drop(folder)
        self.touched.setdefault(name, set()).update(old)

    def _clash(self, newer: dict) -> bool:
        """Whether an entry touched what this change read or wrote."""
        for name, buckets in newer["touched"].items():
            if name not in self.read_of and name not in self.touched:
                continue
            mine = self.read_of.get(name, set()) | self.touched.get(name, set())
            if WHOLE in mine or WHOLE in buckets or mine & set(buckets) or not mine:
                return True
        return False

    def commit(self, writer: str = "", batch: int | None = None) -> int:
        """Makes the change's entry and gives its number; Conflict if another change came first."""
        number, state = self.base, self.found
        while True:
            tables = dict(state["tables"])
            for name, touched in self.touched.items():
                mine, now = self.tables[name], tables.get(name)
                kept = {k: f for k, f in now["folders"].items() if int(k) not in touched} if now else {}
                tables[name] = mine | {"folders": kept | {k: f for k, f in mine["folders"].items() if now is None or int(k) in touched}}
            entry = {"tables": tables, "writers": state["writers"] | ({} if batch is None else {writer: batch}), "touched": {n: sorted(b) for n, b in self.touched.items()}, "writer": writer}
            if shared.put(self.spark, _entry(self.path, number + 1), json.dumps(entry, sort_keys=True)):
                return number + 1
            number += 1
            state = json.loads(shared.text(self.spark, _entry(self.path, number)))
            if self._clash(state) or batch is not None and state["writers"].get(writer) != self.found["writers"].get(writer):
                raise Conflict(f"{self.path}: entry {number} touched the same rows")

    def abandon(self) -> None:
        """Removes what the change has written."""
        for folder in list(self.made):
            self._drop(folder)


def change(spark: SparkSession, path: str, make: Callable[[Change], None], writer: str = "", batch: int | None = None, tries: int = TRIES) -> bool:
    """Runs ``make`` on a change and commits it, again from the newer state where another came first.

    ``batch`` numbers the changes of a ``writer``: one that is not above that writer's last has been
    made before and is passed over (False).  Numbers of different writers have nothing to do with
    each other.
    """
    for n in range(tries):
        mine = Change(spark, path)
        if batch is not None and mine.done(writer, batch):
            return False
        try:
            make(mine)
            mine.commit(writer, batch)
            return True
        except Conflict:
            mine.abandon()
            if n + 1 == tries:
                raise
        except BaseException:
            mine.abandon()
            raise
    raise ValueError("tries is below 1")


def tables(spark: SparkSession, path: str, at: int | None = None) -> list[str]:
    return sorted(_last(spark, path, at)[1]["tables"])


def snapshot(spark: SparkSession, path: str, at: int | None = None) -> dict[str, DataFrame]:
    """All tables of a store as one entry has them, the newest or entry ``at``."""
    return {name: _rows(spark, path, table) for name, table in _last(spark, path, at)[1]["tables"].items()}


def version(spark: SparkSession, path: str) -> int:
    """The number of the newest entry."""
    return _last(spark, path)[0]


def vacuum(spark: SparkSession, path: str, keep: int = 1, older_than: float = 0.0) -> int:
    """Removes entries but the last ``keep``, and folders that those do not name, and says how many folders.

    No reader may use them, and ``older_than`` seconds is to be longer than any change takes, as a
    change's folders are named by no entry until it ends.
    """
    found = sorted(n for n in shared.names(spark, f"{path}/log") if n.endswith(".json") and n[0] != ".")
    kept = [json.loads(shared.text(spark, f"{path}/log/{n}")) for n in found[-keep:]]
    named = {folder for e in kept for t in e["tables"].values() for folder in t["folders"].values()}
    for n in found[:-keep]:
        shared.remove(spark, f"{path}/log/{n}")
    at, files = shared.file_system(spark, path)
    before = (time.time() - older_than) * 1000
    gone = [s.getPath() for s in files.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("change-") and s.getPath().getName() not in named and s.getModificationTime() <= before]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)


# --- a store of one table --------------------------------------------------------------------------

ONE = "table"


def _manifest(spark: SparkSession, path: str) -> dict | None:
    return _last(spark, path)[1]["tables"].get(ONE)


def read(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The table, or some of its buckets; FileNotFoundError if there is none."""
    found = _manifest(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return _rows(spark, path, found, buckets)


def upsert(rows: DataFrame, path: str, keys: list[str], order: str, batch: int | None = None, buckets: int = BUCKETS, writer: str = "") -> bool:
    """``Change.upsert`` on the one table of a store, committed; False if the writer's batch was made before."""
    return change(rows.sparkSession, path, lambda c: c.upsert(ONE, rows, keys, order, buckets), writer, batch)
