"""Paper lists, gold sheets, BibTeX, runs and record files as DataFrames with one order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Header aliases, in order of preference.
ALIASES = {
    "title": ("paper title", "title"),
    "authors": ("authors", "author"),
    "doi": ("doi",),
    "venue": ("conference", "venue"),
    "year": ("year",),
    "label": ("label", "predicted_label"),
    "wireless": ("wireless", "is_wireless"),
}
CONFERENCES = {
    "sigcomm": "conf/sigcomm/sigcomm", "imc": "conf/imc/imc", "nsdi": "conf/nsdi/nsdi", "mobicom": "conf/mobicom/mobicom",
    "mobisys": "conf/mobisys/mobisys", "sensys": "conf/sensys/sensys", "ipsn": "conf/ipsn/ipsn", "conext": "conf/conext/conext",
    "co-next": "conf/conext/conext", "hotnets": "conf/hotnets/hotnets", "icc": "conf/icc/icc", "infocom": "conf/infocom/infocom",
    "globecom": "conf/globecom/globecom",
}
JOURNALS = {"twc": ("journals/twc/twc", 2001), "transwireless": ("journals/twc/twc", 2001), "trans-wireless": ("journals/twc/twc", 2001)}


def csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as strings, with ``file`` and ``ord`` (rows in file order, files in name order)."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.withColumns({"file": F.input_file_name(), "ord": F.monotonically_increasing_id()})


def column(df: DataFrame, name: str, aliases: tuple[str, ...] | None = None) -> Column:
    """The first aliased header's column, trimmed; null where the file has none."""
    have = {c.strip().lower().lstrip("﻿"): c for c in df.columns}
    for alias in aliases or ALIASES[name]:
        if alias in have:
            return F.trim(F.coalesce(F.col(f"`{have[alias]}`"), F.lit("")))
    return F.lit(None).cast("string")


def paper_list(spark: SparkSession, path: str, venue: str | None = None, year: int | None = None) -> DataFrame:
    """``title, authors, venue, year, confidence, ord`` of a CSV paper list."""
    rows = csv(spark, path)
    names = T.authors(column(rows, "authors"))
    return rows.select(
        column(rows, "title").alias("title"), names.alias("authors"), (F.lit(venue) if venue else column(rows, "venue")).alias("venue"),
        (F.lit(year).cast("int") if year else T.year_number(column(rows, "year"))).alias("year"),
        F.when((T._text(column(rows, "title")) != "") & (F.size(names) > 0), 0.99).otherwise(0.60).alias("confidence"), "ord",
    )


def gold(spark: SparkSession, path: str, venue: str | None = None, year: int | None = None, wireless_only: bool = False) -> DataFrame:
    """``title, doi, venue, year, ord`` of a curated sheet; rows without a title are left out."""
    rows = csv(spark, path)
    if not any(a in {c.strip().lower() for c in rows.columns} for a in ALIASES["title"]):
        raise ValueError("the sheet has no title column")
    out = rows.select(*(T.null_words(column(rows, c)).alias(c) for c in ("title", "doi", "venue", "wireless")), T.year_number(T.null_words(column(rows, "year"))).alias("year"), "ord")
    out = out.withColumns({"venue": F.coalesce(F.nullif("venue", F.lit("")), F.lit(venue)), "year": F.coalesce("year", F.lit(year).cast("int"))}).where("title != ''")
    if wireless_only:
        out = out.where(F.lower("wireless").isin("yes", "y", "true", "1"))
    missing = F.col("venue").isNull() | F.col("year").isNull()
    checked = F.when(missing, F.raise_error(F.concat(F.lit("no venue or year for "), "title"))).otherwise(F.col("venue"))
    return out.withColumn("venue", checked.cast("string")).drop("wireless")


def classified(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``title, doi, venue, year, label, file, ord`` of labelled sheets; label is null if absent."""
    rows = csv(spark, path)
    label = F.nullif(F.lower(column(rows, "label")), F.lit(""))
    return rows.select(*(column(rows, c).alias(c) for c in ("title", "doi", "venue")), T.year_number(column(rows, "year")).alias("year"), label.alias("label"), "file", "ord").where(T._text("title") != "")


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    """``key, title, authors, doi, abstract, year, confidence, ord`` of BibTeX entries."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    entries = files.select("file", F.posexplode(F.split("value", r"(?=@\w+\s*\{)")).alias("ord", "entry")).where(F.trim("entry").startswith("@"))
    field = lambda n: T.squash(T.bibtex_field(F.col("entry"), n))
    names = F.filter(F.transform(F.split(field("author"), " and "), lambda a: F.trim(a)), lambda a: a != "")
    return entries.select(
        F.trim(F.regexp_extract("entry", r"@\w+\s*\{\s*([^,]*),", 1)).alias("key"), field("title").alias("title"), names.alias("authors"), field("doi").alias("doi"),
        field("abstract").alias("abstract"), T.year_number(F.coalesce(F.nullif(F.regexp_extract("entry", r"(?i)\byear\s*=\s*\D?(\d{4})", 1), F.lit("")), F.lit(""))).alias("year"),
        F.when((field("title") != "") & (F.size(names) > 0), 0.99).otherwise(0.60).alias("confidence"), "ord",
    )


def labelled_blocks(pages: DataFrame, text: str = "text") -> DataFrame:
    """Papers of pages made of blocks with ``Title:``, ``Authors:`` ... lines."""
    parts = F.split(F.col(text), r"--- PAPER ---|(?m)(?=^Title:)")
    blocks = pages.select(*pages.columns, F.posexplode(parts).alias("ord", "block"))
    field = lambda n: F.trim(F.regexp_extract("block", rf"(?ims)^{n}:[ \t]*(.*?)[ \t]*$", 1))
    title, names = field("Title"), T.authors(field("Authors"))
    out = blocks.select(*(c for c in pages.columns if c != text), "ord", title.alias("title"), names.alias("authors"), field("DOI").alias("doi"), field("Abstract").alias("abstract"), field("Session").alias("session"))
    return out.where("title != ''").withColumn("confidence", F.when(F.size("authors") > 0, 0.95).otherwise(0.60))


RUN_SCHEMA = """venue string, years array<int>, runs array<struct<venue string, year int, run_id bigint, papers array<struct<
 paper_id bigint, title string, authors string, venue string, year int, doi string, bibtex_key string, bibtex string,
 extraction_source string, error string, datasets array<struct<name string, relationship_type string, modalities array<string>,
 osi_layers array<string>, availability boolean, availability_url string, availability_notes string,
 collection_environment string, known_users array<string>, confidence double, evidence_text string, usage_count int>>>>>>"""


def runs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each paper of extraction runs, in order; files named ``master_*`` are left out."""
    files = spark.read.schema(RUN_SCHEMA).json(path, multiLine=True).withColumn("file", F.input_file_name()).where(~F.element_at(F.split("file", "/"), -1).startswith("master_"))
    by_run = files.select("file", F.posexplode("runs").alias("run_ord", "run"))
    papers = by_run.select("file", "run_ord", F.posexplode("run.papers").alias("paper_ord", "p"))
    return papers.select("file", "run_ord", "paper_ord", "p.*")


def records(papers: DataFrame) -> DataFrame:
    """One row for each data set record of ``runs``; blank names are left out."""
    keep = ["file", "run_ord", "paper_ord", "paper_id", "bibtex_key", "doi"]
    each = papers.select(*keep, F.posexplode("datasets").alias("record_ord", "d"))
    return each.select(*keep, "record_ord", "d.*").where(F.trim(F.coalesce("name", F.lit(""))) != "")


def index_records(hits: DataFrame) -> DataFrame:
    """Papers of publication-index hits (``type, title, authors, doi, ee, year``): editors and
    entries that are no papers dropped, markup and number suffixes off."""
    from quillspark.operators.records import non_paper

    plain = T.squash(F.regexp_replace(F.regexp_replace(T._text("title"), "&amp;", "&"), r"\.$", ""))
    names = F.transform("authors", lambda a: F.regexp_replace(F.trim(a), r"\s+\d{4}$", ""))
    out = hits.where(~F.lower(T._text("type")).startswith("editor")).withColumns({"title": plain, "authors": names, "doi": F.coalesce(F.nullif(F.trim("doi"), F.lit("")), F.nullif(T.doi_in("ee"), F.lit("")), F.lit(""))})
    return out.where((F.col("title") != "") & ~non_paper(F.col("title"))).withColumn("confidence", F.when(F.size("authors") > 0, 0.97).otherwise(0.70))


def venue_path(venue: str, year: int) -> str:
    """The index path of a venue's year."""
    key = "".join(c for c in venue.strip().lower() if c.isascii() and (c.isalnum() or c == "-"))
    if key in CONFERENCES:
        return f"{CONFERENCES[key]}{year}"
    if key in JOURNALS:
        path, offset = JOURNALS[key]
        return f"{path}{year - offset}"
    raise ValueError(f"unknown venue {venue}: one of {', '.join(sorted([*CONFERENCES, *JOURNALS]))}")


def pdf_files(spark: SparkSession, path: str, most: int = 10_000_000) -> DataFrame:
    """``path, content`` of files that are PDF by their first bytes and no larger than ``most``."""
    files = spark.read.format("binaryFile").load(path)
    return files.where((F.col("length") <= most) & (F.substring("content", 1, 4) == F.lit(b"%PDF"))).select("path", "content")


def years(text: str) -> list[int]:
    """One year or an inclusive range."""
    first, _, last = text.replace(" ", "").partition("-")
    found = list(range(int(first), int(last or first) + 1))
    if not found:
        raise ValueError(f"{text} is no range of years")
    return found


SEED = "title string, authors string, venue string, year string, abstract string, doi string, paper_url string, acm_url string, pdf_url string, session string, confidence string, evidence_text string"


def seeds_from_replies(replies: DataFrame, venue: str, year: int, reply: str = "reply") -> DataFrame:
    """Papers of a model's JSON replies: a list, or an object with ``papers``; names as a string or
    a list; unknown confidence is 0.80."""
    body = T.salvage_json(reply)
    listed = F.coalesce(F.get_json_object(body, "$.papers"), body)
    each = replies.select(*(c for c in replies.columns if c != reply), F.posexplode(F.from_json(listed, f"array<struct<{SEED.replace(' string', ': string')}>>")).alias("ord", "p"))
    value = lambda c: F.nullif(F.trim(F.col(f"p.{c}")), F.lit(""))
    names = F.coalesce(F.from_json(value("authors"), "array<string>"), F.when(value("authors").isNotNull(), F.array(value("authors"))), F.array().cast("array<string>"))
    out = each.select(
        *(c for c in replies.columns if c != reply), "ord", value("title").alias("title"), F.filter(F.transform(names, lambda a: F.trim(a)), lambda a: a != "").alias("authors"),
        F.coalesce(value("venue"), F.lit(venue)).alias("venue"), F.coalesce(T.year_number(F.col("p.year")), F.lit(year)).alias("year"), value("abstract").alias("abstract"), value("doi").alias("doi"),
        F.coalesce(value("paper_url"), value("acm_url")).alias("paper_url"), value("pdf_url").alias("pdf_url"), value("session").alias("session"),
        F.coalesce(F.col("p.confidence").try_cast("double"), F.lit(0.80)).alias("confidence"),
    )
    return out.where(F.col("title").isNotNull())


def dataset_sheet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of data set sheets, under either spelling of their headers."""
    rows = csv(spark, path)
    pick = lambda *names: T._text(column(rows, "", names))
    keys = F.filter(F.transform(F.split(pick("bibtex citation key", "bibtex citation keys"), ","), lambda k: F.trim(k)), lambda k: k != "")
    return rows.select(
        "ord", pick("dataset name", "canonical name").alias("name"), keys.alias("keys"), pick("modality(ies)", "modalities").alias("modalities"), pick("osi layer (l1-l7)", "osi layers").alias("osi_layers"),
        pick("collection environment", "environment").alias("environment"), pick("availability url").alias("availability_url"), pick("annotations on availability", "availability notes").alias("availability_notes"), F.lit(None).cast("string").alias("doi"),
    ).where("name != ''")


OA_SCHEMA = "runs array<struct<papers array<struct<title string, doi string, pdf_url string, fetchable boolean, oa_status string, provider string>>>>"


def oa_links(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``title, pdf_url`` of open-access runs; the last file wins; ACM library links left out."""
    files = spark.read.schema(OA_SCHEMA).json(path, multiLine=True, mode="PERMISSIVE").withColumn("file", F.input_file_name())
    each = files.select("file", F.posexplode("runs").alias("r", "run")).select("file", "r", F.posexplode("run.papers").alias("n", "p"))
    ok = (T._text("p.pdf_url") != "") & ~T._text("p.pdf_url").contains("dl.acm.org")
    return each.where(ok).groupBy(F.col("p.title").alias("title")).agg(F.max_by("p.pdf_url", F.struct("file", "r", "n")).alias("pdf_url"))


def scored_sheet(spark: SparkSession, path: str, venues: tuple[str, ...] = ("SIGCOMM", "IMC", "NSDI"), between: tuple[int, int] = (2022, 2024)) -> DataFrame:
    """``title_key, title, venue, year, workshop, datasets`` of a manual sheet, the last row of a key."""
    from quillspark.operators.records import last_wins

    rows = csv(spark, path)
    sets = F.filter(F.transform(F.split(T._text(column(rows, "", ("datasets",))), ","), lambda d: F.trim(d)), lambda d: d != "")
    out = rows.select(T.score_title(column(rows, "title")).alias("title_key"), column(rows, "title").alias("title"), F.upper(column(rows, "venue")).alias("venue"), T.year_number(column(rows, "year")).alias("year"), (F.upper(T._text(column(rows, "", ("workshop",)))) == "Y").alias("workshop"), sets.alias("datasets"), "ord")
    return last_wins(out.where(F.col("venue").isin(*venues) & F.col("year").between(*between)), "title_key")


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """The active sheet of a workbook as strings, if openpyxl is installed; read on the driver."""
    try:
        from openpyxl import load_workbook
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    rows = [["" if v is None else str(v) for v in r] for r in load_workbook(path, read_only=True).active.iter_rows(values_only=True)]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows[1:])], [*rows[0], "ord"])


def pdf_text(content: bytes, most: int = 120_000) -> str:
    """Text of a PDF's pages, if pypdf is installed; empty for a PDF that cannot be read."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF text needs pypdf") from e
    try:
        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)[:most]
    except Exception:
        return ""
