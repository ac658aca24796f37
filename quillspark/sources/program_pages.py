"""Papers of conference program pages: session headings, then title, authors, abstract.

What a line is depends on the lines after it, so a page is read as a whole, in Arrow batches.  ``read`` takes
a table of pages; ``ProgramPapers`` is a table function for SQL, called by lateral join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillspark.functions import html

ABSTRACT = "Abstract:"
NEAR, FAR = 2, 5  # an abstract starts this many lines after its title
_SESSION = re.compile(r"\d{1,2}:\d{2}\s*[—-]\s*\d{1,2}:\d{2}\s*\|")
_OTHER = re.compile(r"Day |Session Chair:|Proceedings of |Welcome to |Papers Info$")
_DOI = re.compile(r"/doi/(10\.\d{4,9}/[^/?#]+)")
KIND = "page_id bigint, ord int, title string, authors string, abstract string, session string, paper_url string, doi string, confidence double"


def _control(line: str) -> bool:
    return bool(_SESSION.search(line) or _OTHER.match(line)) or "Best Paper Award" in line


def papers(text: str, links: list[str]) -> Iterator[dict]:
    """The n-th paper goes with the n-th link to a paper."""
    lines = [x for x in (line.strip() for line in text.splitlines()) if x]
    abstracts = {k for k, line in enumerate(lines) if line.startswith(ABSTRACT)}
    urls = iter([u for u in links if "dl.acm.org/doi/10." in u and "/doi/proceedings/" not in u])

    def abstract_of(k: int) -> int | None:
        return next((j for j in range(k + NEAR, k + FAR + 1) if j in abstracts), None)

    def opens(k: int) -> bool:
        return k + 1 < len(lines) and not _control(lines[k]) and k not in abstracts and ("(" in lines[k + 1] or ";" in lines[k + 1]) and abstract_of(k) is not None

    at = next((lines.index(m) + 1 for m in ("Papers Info", "Accepted Papers") if m in lines), 0)
    session = None
    while at < len(lines) and abstracts:
        line = lines[at]
        if _SESSION.search(line):
            session = line.partition("|")[2].strip()
        start = None if _control(line) else abstract_of(at)
        if start is None:
            at += 1
            continue
        end = start + 1
        while end < len(lines) and not _control(lines[end]) and not opens(end):
            end += 1
        names = " ".join(lines[at + 1 : start])
        body = " ".join([lines[start].removeprefix(ABSTRACT).strip(), *lines[start + 1 : end]]).strip()
        url = next(urls, None)
        found = _DOI.search(url or "")
        yield {"title": line, "authors": names, "abstract": body or None, "session": session, "paper_url": url, "doi": found[1] if found else None, "confidence": 0.93 if names else 0.70}
        at = end


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, KIND.split(", "))])


def _of_page(page: str | None, base: str | None) -> Iterator[dict]:
    clean = html.read(page, base)
    for n, paper in enumerate(papers(clean["text"], [x["url"] for x in clean["links"]])):
        yield {"ord": n, **paper}


def read(pages: DataFrame) -> DataFrame:
    """Papers of ``page_id, url, html`` rows, in page order; none of a null page."""

    def run(batches):
        for batch in batches:
            ids, urls, sources = (batch.column(c) for c in ("page_id", "url", "html"))
            rows = [{"page_id": i.as_py(), **p} for i, u, h in zip(ids, urls, sources) for p in _of_page(h.as_py(), u.as_py())]
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "CAST(url AS STRING) AS url", "html").mapInArrow(run, KIND)


_TYPES = {"string": StringType(), "int": IntegerType(), "double": DoubleType()}
FIELDS = StructType([StructField(name, _TYPES[kind]) for name, kind in map(str.split, KIND.split(", ")[1:])])


@dataclass
class _Chosen(AnalyzeResult):
    fields: tuple[str, ...] = ()


class ProgramPapers:
    """``program_papers(html, base, fields)``: a row for each paper of a page, with the constant list
    ``fields`` (``'title, doi'``) only those columns, in that order.

    A null page, or one without papers, has no rows; a null base leaves relative links as they are.
    """

    def __init__(self, chosen: _Chosen):
        self.fields = chosen.fields

    @staticmethod
    def analyze(page: AnalyzeArgument, base: AnalyzeArgument | None = None, fields: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, argument in (("page", page), ("base", base), ("fields", fields)):
            if argument is not None and argument.dataType.typeName() not in ("string", "void"):
                raise ValueError(f"program_papers: {name} must be a string, not {argument.dataType.simpleString()}")
        names = FIELDS.names
        if fields is not None:
            if not fields.isConstantExpression or not fields.value:
                raise ValueError("program_papers: fields must be a constant list of columns")
            names = [x.strip() for x in fields.value.split(",")]
            if unknown := [x for x in names if x not in FIELDS.names]:
                raise ValueError(f"program_papers: no such column: {', '.join(unknown)}; there are {', '.join(FIELDS.names)}")
        return _Chosen(schema=StructType([FIELDS[x] for x in names]), fields=tuple(names))

    def eval(self, page: str | None, base: str | None = None, fields: str | None = None) -> Iterator[tuple]:
        for paper in _of_page(page, base):
            yield tuple(paper[x] for x in self.fields)
