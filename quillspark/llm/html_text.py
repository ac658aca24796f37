"""Main text of HTML pages: places whose subtrees a site repeats go, then what markup says is no article.

1. Each page is parsed and all its element subtrees are hashed (tags and texts below them), beside
   their place (the tags, classes and ids on the way to them).
2. Spark counts, for each host, the pages that each subtree stands on; pages count once for each
   different main text, so copies of one article are one page.  A subtree on ``MIN_PAGES`` or more
   recurs.  Where half of the subtrees at a place recur (``SOME``), those that do are template;
   where nearly all do (``ALL``), the whole place is.
3. Template goes.  So a paragraph that some articles share stays, as most paragraphs at its place do
   not recur, and a menu that differs on a few pages goes with the rest.
4. What counts cannot tell (hosts with few pages, and elements whose texts differ on each page) is
   told by tag, role and class: menus, page headers, footers, sidebars, notices, adverts, forms,
   scripts, styles, reader comments.  Where a page marks its article, text outside it goes too, and
   paragraphs, headings, lists and tables inside it are never template.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by line feeds in page order.  ``<br>`` is white space.

Results for odd input: null html is an empty page with empty text; a null url is a host of its
own; null ids are kept; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch

MIN_PAGES = 5
SOME, ALL = 0.5, 0.9

_TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PROSE = _HEADINGS | set("p blockquote pre li ul ol dl dt dd figure figcaption table caption thead tbody tfoot tr td th hr".split())
_BLOCKS = _PROSE | set("address article aside body center details dialog dir div fieldset footer form head header hgroup html legend main menu nav option section summary".split())
_GONE = set("aside footer nav menu form fieldset noscript template dialog button select option svg object head".split())
_NODES = _BLOCKS | _GONE
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
_WORDS = set(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion nav navbar navigation menu"
    " sidebar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social breadcrumb breadcrumbs comment comments commentlist disqus related widget"
    " widgets pagination pager toolbar masthead skip".split()
)
_OUTER = {"header", "banner"}
_ABOUT = {"has", "no", "with", "without", "layout"}  # such names say what else a page holds


class Page:
    """Nodes in page order (parents first) and the blocks of text under them."""

    __slots__ = ("tag", "parent", "gone", "hash", "place", "main", "blocks")

    def __init__(self, source: str):
        self.tag, self.parent, self.gone, self.hash, self.place, self.main = ["#"], [-1], [False], [0], [0], [False]
        self.blocks: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, parts, buffer = [0], [[]], []
        lower, inner, standing = None, [False], Counter()  # inner: within a main element, for each node

        def flush() -> None:
            if buffer:
                text = " ".join("".join(buffer).split())
                buffer.clear()
                if text:
                    self.blocks.append((stack[-1], text))
                    parts[-1].append(text)

        def close() -> None:
            flush()
            node, own = stack.pop(), parts.pop()
            standing[self.tag[node]] -= 1
            value = xxhash.xxh64_intdigest("\x1f".join([self.tag[node], *own]))
            self.hash[node] = value - (1 << 64) if value >> 63 else value
            parts[-1].append(format(value, "x"))

        at, end = 0, len(source)
        last = source.rfind(">")
        while at < end:
            if at > last:  # no tag ends after this; a comment may still begin
                m, stop = None, source.find("<!--", at)
                end = end if stop < 0 else stop
            else:
                m = _TOKEN.search(source, at)
            text = source[at : m.start() if m else end]
            if text:
                buffer.append(references.unescape(text) if "&" in text else text)
            if not m:
                break
            at = m.end()
            ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if ending:
                if tag in _NODES or tag in ("span", "a", "small", "label"):
                    if standing[tag]:
                        while self.tag[stack[-1]] != tag:
                            close()
                        close()
                    elif tag in _BLOCKS:
                        flush()
                continue
            if tag in _RAW:
                if lower is None:
                    lower = source.lower()
                    if len(lower) != end:
                        lower = re.sub("[A-Z]", lambda x: x[0].lower(), source)
                stop = lower.find("</" + tag, at)
                stop = end if stop < 0 else stop
                after = source.find(">", stop)
                at = end if after < 0 else after + 1
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            words, role, hidden = self._marks(attributes) if attributes and not attributes.isspace() else ((), "", False)
            foreign = bool(_WORDS.intersection(words)) or role in _ROLES or hidden or not inner[stack[-1]] and (tag == "header" or bool(_OUTER.intersection(words)))
            if tag not in _NODES and not (foreign and tag in ("span", "a", "small", "label")):
                continue
            if tag in _BLOCKS:
                flush()
                while len(stack) > 1 and (self.tag[stack[-1]] == "p" or self.tag[stack[-1]] in _CLOSES.get(tag, ()) or tag in _HEADINGS and self.tag[stack[-1]] in _HEADINGS):
                    close()
                if tag == "hr":
                    continue
            if tag in ("html", "body"):
                foreign = False
            elif tag in ("article", "main"):
                foreign = hidden or bool(words) and words[0] in _WORDS
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.gone.append(self.gone[stack[-1]] or tag in _GONE or foreign)
            self.hash.append(0)
            self.place.append(xxhash.xxh64_intdigest(f"{self.place[stack[-1]]} {tag} {' '.join(words)}") >> 1)
            self.main.append(not self.gone[node] and (tag in ("article", "main") or role == "main"))
            inner.append(inner[stack[-1]] or self.main[node])
            standing[tag] += 1
            stack.append(node)
            parts.append([])
        flush()
        while len(stack) > 1:
            close()

    @staticmethod
    def _marks(attributes: str) -> tuple[list[str], str, bool]:
        words, role, hidden = [], "", False
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                for one in value.split():
                    own = _PART.findall(_CAMEL.sub(" ", one).lower())
                    if not _ABOUT.intersection(own):
                        words += own
            elif name == "role":
                role = value.strip().lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
        return words, role, hidden

    def region(self) -> list[bool]:
        """Nodes of the marked article; all nodes where none is marked or it has no text."""
        for tags in (("article",), ("main",), None):
            inside = [False] * len(self.tag)
            for n in range(1, len(self.tag)):
                marked = self.main[n] and (tags is None or self.tag[n] in tags)
                inside[n] = inside[self.parent[n]] or marked
            if any(inside[n] and not self.gone[n] for n, _ in self.blocks):
                return inside
        return [True] * len(self.tag)

    def candidates(self, inside: list[bool]) -> list[bool]:
        """Nodes that can be template: none that hold the article, no prose in it."""
        marked = not all(inside)
        out = [self.tag[n] not in ("#", "html", "body") and not (marked and inside[n] and (self.tag[n] in _PROSE or not inside[self.parent[n]])) for n in range(len(self.tag))]
        if marked:
            holds = inside.copy()
            for n in range(len(self.tag) - 1, 0, -1):
                if holds[n] and not holds[self.parent[n]]:
                    holds[self.parent[n]], out[self.parent[n]] = True, False
        return out

    def text(self, template: set[int] | frozenset[int] = frozenset(), markup: bool = True) -> str:
        """The blocks outside template (places, and subtrees at places); without ``markup`` counts alone tell what goes."""
        inside = self.region()
        could = self.candidates(inside)
        cut = [False] * len(self.tag)
        for n in range(1, len(self.tag)):
            cut[n] = cut[self.parent[n]] or could[n] and (self.place[n] in template or self._at(n) in template)
        return "\n".join(t for n, t in self.blocks if not cut[n] and (not markup or inside[n] and not self.gone[n]))

    def subtrees(self) -> list[tuple[int, int]]:
        """(place, hash) of all subtrees that can be template."""
        could = self.candidates(self.region())
        return sorted({(self.place[n], self._at(n)) for n in range(len(self.tag)) if could[n]})

    def _at(self, n: int) -> int:
        """The name of a subtree at its place."""
        return (self.place[n] * 0x9E3779B97F4A7C15 ^ self.hash[n]) & (1 << 63) - 1


def _subtrees(batches):
    for batch in batches:
        places, hashes, texts = [], [], []
        for source in batch.column("html").to_pylist():
            page = Page(source)
            found = page.subtrees()
            places.append([p for p, _ in found])
            hashes.append([h for _, h in found])
            texts.append(xxhash.xxh64_intdigest(page.text()) >> 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("page_id", "own", "host")] + [pa.array(texts, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))],
            ["page_id", "own", "host", "main", "places", "hashes"],
        )


def _texts(markup: bool):
    def run(batches):
        for batch in batches:
            found = [Page(source).text(frozenset(cut or ()), markup) for source, cut in zip(batch.column("html").to_pylist(), batch.column("cut").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return run


def host(url):
    """The host of a URL, lower case, without user and port."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1))


def _rows(pages: DataFrame) -> DataFrame:
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), source.alias("html"), F.xxhash64(source).alias("own"), F.xxhash64(host(F.col("url"))).alias("host"))


def template(subtrees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, place, hash`` of template subtrees, a null ``hash`` for whole places, from rows
    ``host, place, hash, main``; each subtree counts once for each main text."""
    each = subtrees.select("host", "place", "hash", "main").distinct().groupBy("host", "place", "hash").agg(F.count("*").alias("n"))
    often = F.when(F.col("n") >= min_pages, F.col("n")).otherwise(F.lit(0))
    places = each.groupBy("host", "place").agg((F.sum(often) / F.sum("n")).alias("share")).where(F.col("share") >= SOME)
    single = each.where(F.col("n") >= min_pages).join(places.where(F.col("share") < ALL), ["host", "place"]).select("host", "place", "hash")
    return single.unionByName(places.where(F.col("share") >= ALL).select("host", "place", F.lit(None).cast("bigint").alias("hash")))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, markup: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``."""
    rows = _rows(pages)
    found = rows.select("page_id", "own", "host", "html").mapInArrow(_subtrees, "page_id bigint, own bigint, host bigint, main bigint, places array<bigint>, hashes array<bigint>")
    found = scratch.save(found, "subtrees")
    each = found.select("page_id", "own", "host", "main", F.explode(F.arrays_zip("places", "hashes")).alias("at")).select("page_id", "own", "host", "main", F.col("at.places").alias("place"), F.col("at.hashes").alias("hash"))
    found = scratch.save(template(each, min_pages), "template")
    whole = each.join(found.where("hash is null").select("host", "place"), ["host", "place"]).withColumn("cut", F.col("place"))
    single = each.join(found.where("hash is not null").select("host", "hash"), ["host", "hash"]).withColumn("cut", F.col("hash"))
    key = ["page_id", "own", "host"]
    cut = whole.select(*key, "cut").unionByName(single.select(*key, "cut")).groupBy(*key).agg(F.collect_set("cut").alias("cut"))
    cut = cut.select(*(F.col(c).alias(f"_{c}") for c in key), "cut")
    same = [rows[c].eqNullSafe(F.col(f"_{c}")) for c in key]
    texts = rows.join(cut, same[0] & same[1] & same[2], "left").select("page_id", "url", "html", "cut")
    texts = texts.mapInArrow(_texts(markup), "page_id bigint, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
