"""Lookups in order: each provider is asked for what the ones before it did not have, and no more.

A step has a request for each row, and reads a value from the answer.  Rows that the cache knows are
not asked for, remembered misses neither.  Each step's answers are written before the next begins, so a
run that is started again in the same folder asks nobody twice for what a finished step has.  Requests
that several rows share are made once.  They are dealt to ``lanes`` tasks, each of which keeps to its
part of a host's requests a second and waits as long as the host's answer says.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import enrich
from quillspark.sources import shared

# Answers that may pass, longest wait, what follows an abstract on a page.
RETRYABLE, LONGEST_WAIT = (429, 500, 502, 503, 504), 30.0
TRAILERS = ("BibTeX", "@inproceedings", "Open Access", "Presentation Video", "Download")
MISS = "miss"


@dataclass(frozen=True)
class Step:
    provider: str
    request: Column
    value: Callable[[Column], Column]


@dataclass(frozen=True)
class Budget:
    """Requests a second by host, dealt to ``lanes`` tasks, and how often a request is tried."""

    per_second: Mapping[str, float] = field(default_factory=dict)
    lanes: int = 4
    tries: int = 5
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic


def wait(error: Exception, attempt: int) -> float:
    """Seconds before the next try: what the answer's Retry-After says, else ever longer ones."""
    headers = getattr(error, "headers", None)
    try:
        return min(float(headers.get("Retry-After")), LONGEST_WAIT)
    except (AttributeError, TypeError, ValueError):
        return min(1.5 * 2**attempt, 20.0)


def passing(error: Exception) -> bool:
    """Whether another try may help: a busy server, or a connection that broke."""
    code = getattr(error, "code", None)
    return code in RETRYABLE if code is not None else isinstance(error, OSError)


def asked(requests: DataFrame, fetch: Callable[[str], str | None], budget: Budget) -> DataFrame:
    """``request, payload`` of distinct requests; the payload of one that failed is null."""

    def run(frames):
        due: dict[str, float] = defaultdict(float)
        for f in frames:
            out = []
            for request in f["request"]:
                host, answer = urlsplit(request).netloc, None
                for attempt in range(budget.tries):
                    rate = budget.per_second.get(host)
                    if rate:  # this task's part of the host's rate
                        now = budget.clock()
                        if due[host] > now:
                            budget.sleep(due[host] - now)
                        due[host] = max(now, due[host]) + budget.lanes / rate
                    try:
                        answer = fetch(request)
                        break
                    except Exception as e:
                        if not passing(e):
                            break
                        if attempt + 1 < budget.tries:
                            budget.sleep(wait(e, attempt))
                out.append(answer)
            yield pd.DataFrame({"request": f["request"], "payload": pd.Series(out, dtype=object)})

    return requests.select("request").distinct().repartition(budget.lanes).mapInPandas(run, "request string, payload string")


def run(rows: DataFrame, steps: list[Step], answers: Callable[[str], str | None] | DataFrame, cache: DataFrame | None = None, folder: str | None = None, budget: Budget = Budget()) -> DataFrame:
    """``id, value, provider, request``: the first step's value for each row; provider miss if none has one.

    ``rows`` has a unique ``id`` and what the steps' requests read (``title, doi`` for the cache).
    ``answers`` fetches a request, or is a table ``request, payload`` of recorded ones.  ``cache`` has
    ``key, value, provider``, by DOI and title keys.
    """
    spark = rows.sparkSession
    folder = folder or shared.new(spark, "waterfall")

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}"
        if "_SUCCESS" not in shared.names(spark, path):
            df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = []
    rows = left = kept(rows, "rows")
    if cache is not None:
        keys = F.array_compact(F.array(F.when(F.trim(T._text("doi")) != "", T.doi_key("doi")), F.when(T.guard_title("title") != "", T.title_key("title"))))
        known = rows.select("id", F.posexplode(keys).alias("n", "key")).join(cache.select("key", "value", "provider"), "key")
        first = F.min_by(F.struct("value", "provider"), "n").alias("c")
        known = kept(known.groupBy("id").agg(first).select("id", F.nullif(F.trim("c.value"), F.lit("")).alias("value"), "c.provider", F.lit(None).cast("string").alias("request")), "cached")
        found.append(known.withColumn("provider", F.when(F.col("value").isNull(), MISS).otherwise(F.col("provider"))))
        left = rows.join(known.select("id"), "id", "left_anti")
    for n, step in enumerate(steps):
        todo = left.withColumn("request", step.request).where(F.col("request") != "")
        if isinstance(answers, DataFrame):
            got = todo.select("request").distinct().join(answers.select("request", "payload"), "request")
        else:
            got = asked(todo, answers, budget)
        told = todo.join(kept(got, f"{n}-{step.provider}-answers"), "request")
        value = F.nullif(F.trim(step.value(F.col("payload"))), F.lit(""))
        have = kept(told.select("id", value.alias("value"), F.lit(step.provider).alias("provider"), "request").where("value IS NOT NULL"), f"{n}-{step.provider}")
        found.append(have)
        left = kept(left.join(have.select("id"), "id", "left_anti"), f"{n}-{step.provider}-left")
    none = left.select("id", F.lit(None).cast("string").alias("value"), F.lit(MISS).alias("provider"), F.lit(None).cast("string").alias("request"))
    out = none
    for part in found:
        out = out.unionByName(part)
    return out


def entries(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``key, value, provider`` to put into the cache, under a row's DOI key and its title key, misses too."""
    keys = F.array_compact(F.array(F.when(F.trim(T._text("doi")) != "", T.doi_key("doi")), F.when(T.guard_title("title") != "", T.title_key("title"))))
    each = rows.select("id", F.explode(keys).alias("key")).join(found, "id")
    # of rows that share a key one that has a value, the first of them
    best = F.min_by(F.struct("value", "provider"), F.struct(F.col("value").isNull(), F.col("id"))).alias("v")
    return each.groupBy("key").agg(best).select("key", "v.*")


# --- abstracts ------------------------------------------------------------------------------------


def _long(x: Column) -> Column:
    return F.when(enrich.long_enough(x), x)


def _guarded(found: Column, value: Column) -> Column:
    """A value whose record has the row's title, as far as both have one."""
    return F.when((T._text(found) == "") | enrich.title_guard(F.col("title"), found), value)


def arxiv_abstract(feed: Column) -> Column:
    entry = F.regexp_extract(T._text(feed), r"(?s)<entry>(.*?)</entry>", 1)
    part = lambda tag: T.squash(F.regexp_extract(entry, rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return F.when(enrich.title_guard(F.col("title"), part("title")), _long(part("summary")))


def usenix_page(page: Column) -> Column:
    text = T._text(page)
    segment = F.regexp_extract(text, r"(?s)field-name-field-paper-description\b[^>]*>(.{0,12000})", 1)
    prose = T.strip_tags(segment)
    for trailer in TRAILERS:
        at = F.locate(trailer, prose)
        prose = F.when(at > 1, F.substring(prose, F.lit(1), at - 1)).otherwise(prose)
    prose = F.trim(F.regexp_replace(F.trim(prose), r"\s+[A-Z]{2,6}\s*['’]?\s*\d{2}\s*$", ""))
    return _guarded(T.first_heading(page), _long(prose))


def acm_page(page: Column) -> Column:
    block = T.strip_tags(F.regexp_extract(T._text(page), r"""(?is)(?:id=["']abstract["']|class=["'][^"']*abstractInFull[^"']*["'])[^>]*>?(.*?)</section>""", 1))
    meta = T.strip_tags(F.regexp_extract(T._text(page), r"""(?is)<meta[^>]+name=["'](?:dc\.Description|description)["'][^>]+content=["'](.*?)["']""", 1))
    return F.coalesce(_long(block), _long(meta))


def abstract_steps(mail: str = "", acm: bool = False) -> list[Step]:
    """The providers of abstracts in order, for rows with ``title, doi, url``."""
    doi, title = F.trim(T._text("doi")), F.trim(T._text("title"))
    quoted = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    at = lambda base, c, rest="": F.when(c != "", F.concat(F.lit(base), quoted(c), F.lit(rest)))
    polite = lambda url: enrich.with_mailto(url, mail)
    item = lambda path: lambda p: F.get_json_object(p, path)
    index = lambda p, path: T.inverted_to_text(F.from_json(F.get_json_object(p, path), "map<string, array<int>>"))
    words = F.slice(F.regexp_extract_all(title, F.lit("[A-Za-z0-9]+"), F.lit(0)), 1, 8)
    query = F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.lit("all:"), w)), " AND "))
    s2 = "https://api.semanticscholar.org/graph/v1/paper"
    steps = [
        Step("usenix", F.when(F.col("url").contains("usenix.org"), F.col("url")), usenix_page),
        Step("openalex", polite(at("https://api.openalex.org/works/https://doi.org/", doi)), lambda p: index(p, "$.abstract_inverted_index")),
        Step("openalex", polite(at("https://api.openalex.org/works?search=", title, "&per-page=1")), lambda p: _guarded(item("$.results[0].title")(p), index(p, "$.results[0].abstract_inverted_index"))),
        Step("crossref", polite(at("https://api.crossref.org/works/", doi)), enrich.crossref_abstract),
        Step("semantic_scholar", at(f"{s2}/DOI:", doi, "?fields=title,abstract"), lambda p: _long(item("$.abstract")(p))),
        Step("semantic_scholar", at(f"{s2}/search?query=", title, "&limit=1&fields=title,abstract"), lambda p: _guarded(item("$.data[0].title")(p), _long(item("$.data[0].abstract")(p)))),
        Step("arxiv", F.when(query.isNotNull(), F.concat(F.lit("https://export.arxiv.org/api/query?search_query="), quoted(query), F.lit("&max_results=1"))), arxiv_abstract),
    ]
    return steps + [Step("acm", at("https://dl.acm.org/doi/abs/", doi), acm_page)] * acm
