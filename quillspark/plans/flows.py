"""What a user runs: label papers, see what texts can be had, extract data sets, reconcile; as frames and files.

A flow takes frames and injected callables, and returns frames; it writes where a path is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import classify, enrich, extraction, records, resolve
from quillspark.sources import program_pages, readers, writers

NAME, COMBINED = 0.75, 0.70
LOOSE_NAME, LOOSE_COMBINED = 0.60, 0.55  # where a model confirms pairs and no threshold was chosen


@dataclass(frozen=True)
class Labelled:
    papers: DataFrame
    by_year: DataFrame


def label(papers: DataFrame, years: list[int], vocabulary: classify.Vocabulary = classify.Vocabulary(), sheet: str | None = None, json: str | None = None) -> Labelled:
    """Papers of some years with their keyword labels, and counts for each venue and year, each venue
    and all.  ``papers`` has ``ord, title, authors, doi, abstract, venue, year``."""
    mine = classify.keyword(papers.where(F.col("year").isin(*years)), vocabulary).withColumn("has_abstract", F.col("used_abstract"))
    if sheet:
        writers.sheet(mine, sheet)
    if json:
        writers.nested_runs(mine.select("ord", *writers.CLASSIFIED), json if json.lower().endswith(".json") else f"{json}.json")
    return Labelled(mine, classify.breakdown(mine, "venue", "year"))


def coverage(papers: DataFrame, doi_cache: DataFrame, payloads: dict[str, Column], answers: DataFrame) -> DataFrame:
    """DOIs filled by title, then how many papers of each venue and year have DOI, abstract and free text."""
    return enrich.text_coverage(enrich.resolved_dois(papers, doi_cache, payloads), answers, "venue", "year")


def seeds(pages: DataFrame, venue: str, year: int, reply: Column | None = None) -> DataFrame:
    """Papers of program pages (``page_id, url, html``): by rule, and for pages where the rules find
    none by a model's ``reply``, a column on those pages, if one is given."""
    found = program_pages.read(pages).withColumns({"authors": T.authors("authors"), "venue": F.lit(venue), "year": F.lit(year), "pdf_url": F.lit(None).cast("string")})
    if reply is None:
        return found
    rest = pages.join(found.select("page_id").distinct(), "page_id", "left_anti").select("page_id", reply.alias("reply"))
    return found.unionByName(readers.seeds_from_replies(rest, venue, year).select(*found.columns))


def pages(spark: SparkSession, paths: list[str], fetch: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """``url, html`` of pages.  Files (paths or file addresses) are read by Spark; other addresses go to
    ``fetch``, on the executors.  An address without ``fetch`` is a ValueError."""
    web = [p for p in paths if "://" in p and p.split("://")[0].lower() in ("http", "https")]
    files = [p for p in paths if p not in web]
    if web and fetch is None:
        raise ValueError("web addresses need a callable that fetches them")
    out = None
    if files:
        out = spark.read.text(files, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    if web:
        asked = spark.createDataFrame([(p,) for p in web], "url string")
        told = enrich.fetched(asked.withColumn("at", F.col("url")), "url", "at", fetch).select("url", F.col("payload").alias("html"))
        out = told if out is None else out.unionByName(told)
    return out


@dataclass(frozen=True)
class Reconciled:
    matches: DataFrame
    canonical: DataFrame


def reconcile(
    records: DataFrame, by_url: bool = True, by_likeness: bool = True, reply: Column | None = None, name: float = NAME, combined: float = COMBINED, report: str | None = None, sheet: str | None = None
) -> Reconciled:
    """Records that stand for one data set: shared links, then likeness, then a model's verdict.

    ``reply`` is the model's answer for a similar pair; with it, thresholds left as they are fall to
    looser ones.  ``report`` and ``sheet`` are folders for the matches (JSON) and the merged list (CSV).
    """
    if reply is not None:
        name, combined = LOOSE_NAME if name == NAME else name, LOOSE_COMBINED if combined == COMBINED else combined
    sure = resolve.url_pairs(records)
    matches = sure if by_url else sure.limit(0)
    if by_likeness:
        like = resolve.first_similar(records, matches, name, combined)
        matches = matches.unionByName(like if reply is None else resolve.confirmed(like, reply))
    canonical = resolve.consolidate(records, matches)
    if report:
        ends = [records.select(F.col("ord").alias(f"ord_{s}"), F.col("keys").alias(f"keys_{s}")) for s in "ab"]
        told = matches.join(ends[0], "ord_a").join(ends[1], "ord_b").withColumn("ord", F.struct("ord_a", "ord_b"))
        writers.match_report(told, records.count()).write.mode("overwrite").json(report)
    if sheet:
        writers.consolidated(canonical, sheet)
    return Reconciled(matches, canonical)


@dataclass(frozen=True)
class Extracted:
    papers: DataFrame
    datasets: DataFrame
    rejected: DataFrame
    asked: DataFrame


def extract(
    papers: DataFrame,
    cache: DataFrame | None = None,
    ask: Callable[[Column], Column] | None = None,
    labels: DataFrame | None = None,
    live: Callable[[DataFrame], DataFrame] | None = None,
    entries: DataFrame | None = None,
    template: str = extraction.PROMPT,
    folder: str | None = None,
    slug: str = "extraction",
    work: str | None = None,
) -> Extracted:
    """Data sets of papers from a model's replies, and the three sheets that hold them.

    ``papers`` has ``id`` (unique), ``ord`` (their order), ``title, authors, venue, year, doi, abstract,
    pdf_text``.  With ``labels`` (``id, label``) papers labelled no are left out.  ``cache`` (``key, reply``) and
    ``ask`` answer prompts; ``asked`` is what the cache lacked.  ``live`` maps ``url`` rows to ``url, live`` and
    says whether an address answers, in the place of what the paper says.  ``entries`` (``id, bibtex``) are
    citations that were found; others are made.  With ``folder`` sheets are written there.  ``work`` is a
    folder that a run which starts again continues from.
    """
    chosen = papers if labels is None else classify.to_extract(papers, labels)
    told, asked = extraction.replies(chosen, extraction.attempts(template), cache, ask, work)
    names = extraction.addresses(extraction.datasets(told))
    if live is not None:
        answers = live(names.where("availability_url <> ''").select(F.col("availability_url").alias("url")).distinct())
        known = answers.groupBy(F.col("url").alias("availability_url")).agg(F.max("live").alias("live"))
        names = names.join(known, "availability_url", "left").withColumn("availability", F.when(F.col("availability_url") != "", F.coalesce("live", F.lit(False))).otherwise(F.col("availability"))).drop("live")
    facts = chosen.select("id", "ord", "title", "authors", "venue", "year", "doi", T.bibtex_key(F.col("authors"), F.col("year"), F.col("title")).alias("bibtex_key"))
    counted = records.usage_counts(names.join(facts.select("id", T._text(F.col("venue").cast("string")).alias("venue"), T._text(F.col("year").cast("string")).alias("year")), "id"))
    fields = [c for c in names.columns if c not in ("id", "place")]
    listed = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", *fields, "usage_count"))).alias("datasets"))
    none = F.array().cast(dict(listed.dtypes)["datasets"])
    cited = T.minimal_bibtex(F.col("bibtex_key"), F.col("title"), F.col("authors"), F.col("year"), F.col("venue"), F.col("doi"))
    if entries is not None:
        found = entries.where(T._text("bibtex").rlike(r"^\s*@")).groupBy("id").agg(F.min("bibtex").alias("_entry"))
        facts = facts.join(found, "id", "left")
        cited = F.coalesce(F.when(F.col("_entry").isNotNull(), T.rekey_bibtex(F.trim("_entry"), F.col("bibtex_key"))), cited)
    whole = facts.withColumn("bibtex", cited).join(told.select("id", "extraction_source", "error"), "id", "left").join(listed, "id", "left").withColumn("datasets", F.coalesce("datasets", none)).drop("_entry")
    if folder:
        writers.extraction(whole, folder, slug)
    return Extracted(whole, names, extraction.quarantine(told), asked)
