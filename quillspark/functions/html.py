"""Readable text and links of a page; a struct of both, one parse for each page."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

BREAKS = frozenset("p div li br h1 h2 h3 h4 h5 h6 tr td th section article ul ol dl dt dd header footer main nav table".split())
SKIPPED = frozenset(("script", "style", "noscript"))


class _Reader(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.links = base, [], []
        self.skipped, self.anchor = 0, None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped += 1
        elif tag == "a":
            self._leave_anchor()
            href = dict(attrs).get("href")
            self.anchor = (urljoin(self.base, href), []) if href else None
        elif tag in BREAKS:
            self._put("\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "a":
            self._leave_anchor()
        elif tag in BREAKS:
            self._put("\n")

    def handle_data(self, data):
        if not self.skipped:
            self._put(data)

    def _put(self, text):
        (self.anchor[1] if self.anchor else self.out).append(text)

    def _leave_anchor(self):
        if self.anchor:
            url, words = self.anchor
            text = " ".join("".join(words).split())
            self.anchor = None
            self.links.append({"text": text, "url": url})
            self.out.append(f" {text} [{url}] " if text else f" [{url}] ")

    def finish(self):
        self.close()
        self._leave_anchor()
        lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(self.out).split("\n"))
        return {"text": "\n".join(x for x in lines if x), "links": self.links}


def read(source: str | None, base: str | None) -> dict:
    """``text`` and ``links`` of a page; none of a null one."""
    reader = _Reader(base or "")
    reader.feed(source or "")
    return reader.finish()


LINK = StructType().add("text", StringType()).add("url", StringType())
KIND = StructType().add("text", StringType()).add("links", ArrayType(LINK))


SLICE = 64  # pages whose links are Python objects at once
_ARROW = pa.struct([("text", pa.string()), ("links", pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())])))])


@F.arrow_udf(KIND)
def clean(page: pa.Array, base: pa.Array) -> pa.Array:
    parts = []
    for start in range(0, len(page), SLICE):
        some = zip(page.slice(start, SLICE), base.slice(start, SLICE))
        parts.append(pa.array([read(source.as_py(), url.as_py()) for source, url in some], _ARROW))
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)
