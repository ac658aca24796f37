"""Missing metadata from ordered chains of lookups, and open-access coverage.

A provider is a function from a payload column to a value column; a chain takes the first value
that its guard lets through.  Live requests are made by callables that the caller injects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.match import title_guard

LEAST_ABSTRACT = 40


def long_enough(abstract: Column, least: int = LEAST_ABSTRACT) -> Column:
    return F.length(F.coalesce(abstract, F.lit(""))) >= least


def guarded(value: Column, expected_title: Column, found_title: Column) -> Column:
    return F.when(title_guard(expected_title, found_title), value)


def chain(candidates: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, provider) of the first candidate that has one; provider is miss if none has."""
    named = [(n, F.nullif(F.trim(c), F.lit(""))) for n, c in candidates]
    who = F.lit("miss")
    for name, value in reversed(named):
        who = F.when(value.isNotNull(), name).otherwise(who)
    return F.coalesce(*(v for _, v in named)), who


def openalex_abstract(payload: Column) -> Column:
    index = F.from_json(F.get_json_object(payload, "$.abstract_inverted_index"), "map<string, array<int>>")
    return T.inverted_to_text(index)


def crossref_abstract(payload: Column) -> Column:
    found = T.strip_tags(F.get_json_object(payload, "$.message.abstract"))
    return F.when(long_enough(found), found)


def usenix_abstract(page: Column) -> Column:
    found = T.strip_tags(F.regexp_extract(page, r"(?is)field-name-field-paper-description[^>]*>(.{0,12000})", 1))
    return F.when(long_enough(found), found)


# --- DOIs by title ---------------------------------------------------------------------------


def bare_doi(x: Column) -> Column:
    """A DOI without one resolver address or ``doi:`` before it; its case is kept."""
    return F.regexp_replace(F.trim(T._text(x)), r"^(?i)(?:https?://doi\.org/|doi:)", "")


def with_mailto(url: Column, mail: str) -> Column:
    """The address with a contact, which polite providers ask for."""
    if not mail.strip():
        return url
    sign = F.when(url.contains("?"), "&").otherwise("?")
    return F.concat(url, sign, F.lit("mailto="), F.replace(F.url_encode(F.lit(mail.strip())), F.lit("+"), F.lit("%20")))


def crossref_doi(title: Column, payload: Column) -> Column:
    """The first item's DOI, if its title passes the guard."""
    doi = F.get_json_object(payload, "$.message.items[0].DOI")
    return guarded(F.lower(F.nullif(F.trim(doi), F.lit(""))), title, F.get_json_object(payload, "$.message.items[0].title[0]"))


def openalex_doi(title: Column, payload: Column) -> Column:
    doi = bare_doi(F.get_json_object(payload, "$.results[0].doi"))
    return guarded(F.lower(F.nullif(doi, F.lit(""))), title, F.get_json_object(payload, "$.results[0].title"))


def resolved_dois(papers: DataFrame, cache: DataFrame, payloads: dict[str, Column]) -> DataFrame:
    """``papers`` (with ``title, doi``) with blank DOIs filled and ``doi_provider``.

    A DOI that is given stays (provider given).  For the others the cache (``title_key, doi,
    provider``) decides, remembered misses too; then the answers in ``payloads``, columns by provider,
    in order; papers without a title are not looked up (no provider).
    """
    parsers = {"crossref": crossref_doi, "openalex": openalex_doi}
    given, titled = F.trim(T._text("doi")) != "", F.trim(T._text("title")) != ""
    known = cache.select("title_key", F.col("doi").alias("_doi"), F.col("provider").alias("_who"))
    found, who = chain([(name, parsers[name](F.col("title"), payload)) for name, payload in payloads.items()])
    joined = papers.withColumn("title_key", T.title_key("title")).join(known, "title_key", "left")
    cached = F.col("_who").isNotNull()
    hit = F.when(F.col("_who") != "miss", F.nullif(F.col("_doi"), F.lit("")))
    provider = F.when(given, "given").when(~titled, F.lit(None)).when(cached, F.when(hit.isNotNull(), F.col("_who")).otherwise("miss")).otherwise(who)
    doi = F.when(given, F.trim("doi")).when(titled, F.when(cached, hit).otherwise(found))
    return joined.withColumns({"doi_provider": provider, "doi": F.coalesce(doi, F.lit(""))}).drop("_doi", "_who", "title_key")


def wanted(doi: Column, title: Column, abstract: Column, pdf: Column) -> tuple[Column, Column]:
    """(DOI to be looked up, abstract to be looked up): an abstract only without a PDF's address."""
    blank = lambda c: F.trim(T._text(c)) == ""
    return blank(doi) & ~blank(title), blank(pdf) & blank(abstract)


def text_coverage(papers: DataFrame, answers: DataFrame, *keys: str) -> DataFrame:
    """Papers with DOI, abstract and free text for each of ``keys``; ``answers`` has a PDF's address
    for each ``id``."""
    free = answers.where(F.coalesce("pdf_url", F.lit("")) != "").select("id").distinct().withColumn("_free", F.lit(True))
    some = lambda c: F.count_if(F.trim(T._text(c)) != "").alias(f"with_{c}")
    told = papers.join(free, "id", "left").withColumn("fetchable", F.coalesce("_free", F.lit(False)))
    return told.groupBy(*keys).agg(F.count("*").alias("total"), some("doi"), some("abstract"), F.count_if("fetchable").alias("fetchable")).withColumn("fetchable_pct", F.round(F.col("fetchable") * 100.0 / F.col("total"), 1))


def paper_urls(sources: DataFrame, papers: DataFrame, favoured: str = "usenix.org") -> DataFrame:
    """The preferred address of each of the papers that has sources."""
    return preferred_url(sources.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi"), favoured=favoured)


def open_access(options: list[tuple[str, Column]]) -> Column:
    """Of ordered (provider, url) options the first that is not on the ACM library, else the last."""
    given = F.filter(F.array(*(F.struct(F.lit(n).alias("provider"), u.alias("url")) for n, u in options)), lambda o: F.coalesce(o["url"], F.lit("")) != "")
    free = F.filter(given, lambda o: ~o["url"].contains("dl.acm.org"))
    return F.coalesce(F.try_element_at(free, F.lit(1)), F.try_element_at(given, F.lit(-1)))


def coverage(papers: DataFrame, *keys: str) -> DataFrame:
    """Papers that can be fetched, and their share, for each key."""
    can = F.col("fetchable")
    return papers.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(can).alias("fetchable")).withColumn("fetchable_pct", F.round(F.col("fetchable") * 100.0 / F.col("total"), 1))


def coverage_by(papers: DataFrame, column: str) -> DataFrame:
    """Fetchable papers for each value of a column; blank ones are unknown."""
    value = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("unknown"))
    return papers.where("fetchable").groupBy(value.alias(column)).agg(F.count("*").alias("papers"))


def preferred_url(sources: DataFrame, key: str = "paper_id", favoured: str = "usenix.org") -> DataFrame:
    """For each paper the first address that is not blank; the favoured host goes before others."""
    ok = F.trim(T._text("url")) != ""
    return sources.where(ok).groupBy(key).agg(F.min_by("url", F.struct(~F.col("url").contains(favoured), F.col("ord"))).alias("url"))


def fetched(rows: DataFrame, key: str, request: str, fetch: Callable[[list[str]], Iterable[str | None]], batch: int = 400) -> DataFrame:
    """``key, payload`` from an injected batch request; one request for each distinct ``request``,
    ``batch`` at a time, on the executors."""
    kind = dict(rows.dtypes)[key]
    asked = rows.where(F.col(request).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(request).orderBy(key))).where("_n = 1").select(key, request)

    def run(frames):
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "payload": list(fetch(part[request].tolist()))})

    return asked.mapInPandas(run, f"{key} {kind}, payload string")


def live(rows: DataFrame, key: str, url: str, head: Callable[[str], int], get: Callable[[str], int]) -> DataFrame:
    """``key, live``: whether an address answers with a status below 400, asked with ``head``, then with
    ``get`` if that fails or is refused; one question for each distinct address, blank ones are not live."""

    def status(ask, at):
        try:
            return ask(at) < 400
        except Exception:
            return False

    asked = rows.select(F.trim(T._text(url)).alias("_at")).where("_at <> ''").distinct()

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"_at": f["_at"].to_numpy(), "_ok": [status(head, at) or status(get, at) for at in f["_at"]]})

    told = asked.mapInPandas(run, "_at string, _ok boolean")
    return rows.withColumn("_at", F.trim(T._text(url))).join(told, "_at", "left").select(key, F.coalesce("_ok", F.lit(False)).alias("live"))


def available(rows: DataFrame, key: str, answers: DataFrame) -> DataFrame:
    """Open access as the address's own answer has it, where it was asked for; else as it was."""
    return rows.join(answers, key, "left").withColumn("availability", F.coalesce("live", "availability")).drop("live")


def citations(papers: DataFrame, key: str, fetch: Callable[[list[str]], Iterable[str | None]]) -> DataFrame:
    """``papers`` with ``bibtex``: the entry found for the DOI under the paper's own key, else a minimal
    one.  ``papers`` has ``title, authors, year, venue, doi, bibtex_key``."""
    asked = papers.withColumn("_doi", F.nullif(F.trim(T._text("doi")), F.lit("")))
    found = fetched(asked, key, "_doi", fetch).withColumnRenamed("payload", "_entry")
    entries = asked.select(key, "_doi").join(found, key).where(T._text("_entry").rlike(r"^\s*@")).select("_doi", "_entry")
    plain = T.minimal_bibtex(F.col("bibtex_key"), F.col("title"), F.col("authors"), F.col("year"), F.col("venue"), F.col("doi"))
    known = F.when(F.col("_entry").isNotNull(), T.rekey_bibtex(F.trim("_entry"), F.col("bibtex_key")))
    return asked.join(entries, "_doi", "left").withColumn("bibtex", F.coalesce(known, plain)).drop("_doi", "_entry")


def with_retry(call: Callable[[], str], retryable: Callable[[Exception], bool], sleep: Callable[[float], None], tries: int = 5, most: float = 20.0) -> str:
    """Calls again after 1, 2, 4 ... seconds, ``most`` at a time, while the error may pass."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:
            if n + 1 == tries or not retryable(e):
                raise
            sleep(min(most, 2.0**n))
    raise ValueError("tries is below 1")


# --- open-access answers; each is a struct of fetchable, status, license, pdf_url, provider ---

STATUSES = ("gold", "green", "hybrid", "bronze")  # Fixed values.


def _answer(ok: Column, status: Column, license: Column, url: Column, provider: str) -> Column:
    given = ok & (F.coalesce(url, F.lit("")) != "")
    return F.when(given, F.struct(status.alias("status"), F.coalesce(license, F.lit("")).alias("license"), url.alias("pdf_url"), F.lit(provider).alias("provider")))


def _at(payload: Column, path: str) -> Column:
    return F.nullif(F.trim(F.get_json_object(payload, path)), F.lit(""))


def unpaywall(payload: Column) -> Column:
    return _answer(_at(payload, "$.is_oa") == "true", F.coalesce(_at(payload, "$.oa_status"), F.lit("green")), _at(payload, "$.best_oa_location.license"), F.coalesce(_at(payload, "$.best_oa_location.url_for_pdf"), _at(payload, "$.best_oa_location.url")), "unpaywall")


def openalex_access(payload: Column, title: Column | None = None) -> Column:
    """With ``title``, the payload came from a search and must pass the title guard."""
    ok = _at(payload, "$.open_access.is_oa") == "true"
    ok = ok if title is None else ok & title_guard(title, _at(payload, "$.title"))
    return _answer(ok, F.coalesce(_at(payload, "$.open_access.oa_status"), F.lit("green")), _at(payload, "$.best_oa_location.license"), F.coalesce(_at(payload, "$.best_oa_location.pdf_url"), _at(payload, "$.open_access.oa_url")), "openalex")


def semantic_scholar_access(payload: Column, title: Column | None = None) -> Column:
    status = F.lower(F.coalesce(_at(payload, "$.openAccessPdf.status"), F.lit("")))
    ok = F.lit(True) if title is None else title_guard(title, _at(payload, "$.title"))
    return _answer(ok, F.when(status.isin(*STATUSES), status).otherwise("green"), _at(payload, "$.openAccessPdf.license"), _at(payload, "$.openAccessPdf.url"), "semantic_scholar")


def arxiv_access(feed: Column, title: Column) -> Column:
    entry = F.regexp_extract(T._text(feed), r"(?s)<entry>(.*?)</entry>", 1)
    found = T.squash(F.regexp_extract(entry, r"(?s)<title>(.*?)</title>", 1))
    return _answer(title_guard(title, found), F.lit("green"), F.lit("arxiv"), T.arxiv_pdf(T.squash(F.regexp_extract(entry, r"(?s)<id>(.*?)</id>", 1))), "arxiv")


def usenix_access(url: Column, page: Column) -> Column:
    """The page's PDF that is no slide deck, else its first PDF, else the page itself."""
    links = F.regexp_extract_all(T._text(page), F.lit(r"""href=["']([^"']*/system/files/[^"']*\.pdf)["']"""), F.lit(1))
    papers = F.filter(links, lambda x: ~F.lower(x).contains("slide"))
    best = F.coalesce(F.try_element_at(papers, F.lit(1)), F.try_element_at(links, F.lit(1)))
    whole = F.when(best.startswith("/"), F.concat(F.lit("https://www.usenix.org"), best)).otherwise(best)
    return _answer(T._text(url).contains("usenix.org"), F.lit("gold"), F.lit("usenix-open-access"), F.coalesce(whole, url), "usenix")


def first_free(*answers: Column) -> Column:
    """The first answer whose PDF is not on the ACM library, else the last answer."""
    given = F.filter(F.array(*answers), lambda a: a.isNotNull())
    free = F.filter(given, lambda a: ~a["pdf_url"].contains("dl.acm.org"))
    return F.coalesce(F.try_element_at(free, F.lit(1)), F.try_element_at(given, F.lit(-1)))
