"""One JSON document or one sheet from many tasks, put in place whole or not at all.

Rows come sorted.  Each task writes its part into a folder beside the target; the commit copies the parts
in order into one file, a block at a time, and moves it over the target, unless the target has the same
content already: then its time stamp stays.  A task or job that fails leaves the target as it was.

A document is made of tokens, rows of ``kind, depth, name, value``: ``item`` is a value, with a name in an
object; ``open`` begins an object, whose fields are ``value`` if it holds a list of that ``name``, and which
has that ``name`` and members if ``value`` is null; ``close`` ends it, ``name`` null for one with members.
Commas go between neighbours, also where those come from two tasks.  The layout is that of Python's
``json`` with an indent of 2.

Paths are those that pyarrow's file systems know (a mounted shared folder, ``hdfs://``, ``s3://``); the
file system's move must replace its target.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "quillspark_document"
BLOCK = 1 << 20
TOKENS = "kind string, depth int, name string, value string"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _dumped(value: str, depth: int) -> str:
    return json.dumps(json.loads(value), indent=2, ensure_ascii=False).replace("\n", "\n" + "  " * depth)


def lead(before: str, kind: str, depth: int, listed: bool) -> str:
    """What stands between a token and the one before it."""
    if kind == "close":
        return "" if before == "open" else "\n" + "  " * (depth + listed)
    return ("," if before in ("item", "close") else "") + "\n" + "  " * depth


def shown(kind: str, depth: int, name: str | None, value: str | None) -> str:
    """A token's own text."""
    pad, label = "  " * depth, "" if name is None else json.dumps(name, ensure_ascii=False)
    if kind == "item":
        return (f"{label}: " if label else "") + _dumped(value, depth)
    if kind == "close":
        return "}" if name is None else f"]\n{pad}}}"
    if value is None:
        return (f"{label}: " if label else "") + "{"
    fields = _dumped(value, depth)
    fields = "{" if fields == "{}" else fields.removesuffix(f"\n{pad}}}") + ","
    return f"{fields}\n{pad}  {label}: ["


@dataclass
class _Part(WriterCommitMessage):
    place: int
    path: str
    first: tuple[str, int, bool] | None
    last: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.kind, self.target, self.columns = options["kind"], options["path"], columns
        self.root = json.loads(options.get("root", "null"))
        folder, _, name = self.target.rpartition("/")
        self.stage = f"{folder}/.{name}-{uuid.uuid4().hex}"
        # made here and not by tasks: one that is killed late would make it again after it was removed
        system, stage = _system(self.stage)
        system.create_dir(stage, recursive=True)

    def write(self, rows) -> _Part:
        task = TaskContext.get()
        system, stage = _system(self.stage)
        path, first, last = f"{stage}/{task.partitionId()}-{task.taskAttemptId()}", None, ""
        with system.open_output_stream(path) as out:
            sheet = io.StringIO(newline="")
            lines = csv.writer(sheet)
            for row in rows:
                if self.kind == "csv":
                    lines.writerow(["" if v is None else v for v in row])
                    text = sheet.getvalue()
                    sheet.seek(0), sheet.truncate()
                else:
                    kind, depth, name, value = (row[c] for c in ("kind", "depth", "name", "value"))
                    text = shown(kind, depth, name, value)
                    if first:
                        text = lead(last, kind, depth, name is not None) + text
                    first, last = first or (kind, depth, name is not None), kind
                out.write(text.encode())
        return _Part(task.partitionId(), path, first, last)

    def commit(self, messages) -> None:
        system, stage = _system(self.stage)
        target = _system(self.target)[1]
        seen, whole = hashlib.sha256(), f"{stage}/whole"
        with system.open_output_stream(whole) as out:

            def put(data: bytes) -> None:
                seen.update(data)
                out.write(data)

            if self.kind == "csv":
                head = io.StringIO(newline="")
                csv.writer(head).writerow(self.columns)
                put(head.getvalue().encode())
            else:
                put(shown("open", 0, *self.root).encode())
            before = "open"
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.place):
                if part.first:
                    put(lead(before, *part.first).encode())
                    before = part.last
                with system.open_input_stream(part.path) as source:
                    while data := source.read(BLOCK):
                        put(data)
            if self.kind != "csv":
                name = self.root[0] if self.root[1] is not None else None
                put((lead(before, "close", 0, name is not None) + shown("close", 0, name, None)).encode())
        if self._digest(system, target) != seen.hexdigest():
            system.move(whole, target)
        system.delete_dir(stage)

    def _digest(self, system: fs.FileSystem, path: str) -> str | None:
        if system.get_file_info(path).type != fs.FileType.File:
            return None
        seen = hashlib.sha256()
        with system.open_input_stream(path) as source:
            while data := source.read(BLOCK):
                seen.update(data)
        return seen.hexdigest()

    def abort(self, messages) -> None:
        system, stage = _system(self.stage)
        if system.get_file_info(stage).type != fs.FileType.NotFound:
            system.delete_dir(stage)


class Document(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TOKENS

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema.names)


def _save(df: DataFrame, path: str, **options: str) -> None:
    df.sparkSession.dataSource.register(Document)
    df.write.format(NAME).options(path=path, **options).mode("append").save()


def sheet(df: DataFrame, path: str, order: list[Column]) -> None:
    """One CSV file with a header, rows in order; lists joined by ``; ``, lines end as Python's ``csv`` ends them."""
    kinds = dict(df.dtypes)
    plain = [F.array_join(c, "; ").alias(c) if kinds[c].startswith("array") else F.col(c).cast("string").alias(c) for c in df.columns]
    _save(df.orderBy(*order).select(*plain), path, kind="csv")


def _json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def listed(rows: DataFrame, path: str, fields: dict, name: str, order: list[Column]) -> None:
    """``{fields, name: [rows]}``, rows in order."""
    tokens = rows.orderBy(*order).select(F.lit("item").alias("kind"), F.lit(2).alias("depth"), F.lit(None).cast("string").alias("name"), _json(*rows.columns).alias("value"))
    _save(tokens, path, kind="json", root=json.dumps([name, json.dumps(fields, ensure_ascii=False)]))


def runs(papers: DataFrame, path: str, fields: dict, order: str = "ord", extra: DataFrame | None = None) -> None:
    """``{fields, "runs": [{venue, year, total_papers, papers: [...]}]}``, by venue, year and ``order``.

    A run's papers are spread over tasks like any others.  ``extra`` has ``venue, year`` (each pair once) and
    further fields of a run.
    """
    head = papers.groupBy("venue", "year").agg(F.count("*").alias("total_papers"))
    if extra is not None:
        more = extra.select(F.col("venue").alias("_v"), F.col("year").alias("_y"), *(c for c in extra.columns if c not in ("venue", "year")))
        head = head.join(more, head.venue.eqNullSafe(F.col("_v")) & head.year.eqNullSafe(F.col("_y")), "left").drop("_v", "_y")
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast(dict(papers.dtypes)[order])
    token = lambda df, n, kind, depth, name, value, at: df.select("venue", "year", F.lit(n).alias("n"), at.alias("_at"), F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), F.lit(name).cast("string").alias("name"), value.alias("value"))
    each = token(head, 0, "open", 2, "papers", _json(*head.columns), nowhere)
    each = each.unionByName(token(papers, 1, "item", 4, None, _json(*(c for c in papers.columns if c != order)), F.col(order)))
    each = each.unionByName(token(head, 2, "close", 2, "papers", none, nowhere))
    tokens = each.orderBy("venue", "year", "n", "_at", "value").select("kind", "depth", "name", "value")
    _save(tokens, path, kind="json", root=json.dumps(["runs", json.dumps(fields, ensure_ascii=False)]))


def members(entries: DataFrame, path: str, sections: list[str]) -> None:
    """``{section: {key: value}}`` with keys in order, all ``sections`` even if empty.

    ``entries`` has ``section, key, value`` (JSON); of rows with one key the least value stays, and rows of other
    sections are refused before anything is written.
    """
    spark = entries.sparkSession
    heads = spark.createDataFrame([(s,) for s in sections], "section string")
    if entries.select("section").distinct().join(heads, "section", "left_anti").limit(1).count():
        raise ValueError("an entry's section is not among the document's")
    one = entries.groupBy("section", "key").agg(F.min("value").alias("value"))
    none = F.lit(None).cast("string")
    token = lambda df, n, kind, depth, name, value: df.select("section", F.lit(n).alias("n"), F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), name.alias("name"), value.alias("value"))
    each = token(heads, 0, "open", 1, F.col("section"), none).unionByName(token(one, 1, "item", 2, F.col("key"), F.col("value"))).unionByName(token(heads, 2, "close", 1, none, none))
    _save(each.orderBy("section", "n", "name").select("kind", "depth", "name", "value"), path, kind="json", root=json.dumps([None, None]))
