"""Data sets of papers from a model's replies: prompts, attempts in order, typed records.

A paper has attempts, each a prompt or null where it does not apply: its file's text, its abstract, its
title.  The next attempt is made where the one before brought no JSON object.  Replies are kept by the
prompt's key, so equal prompts are asked once and a run that starts again in its folder asks nothing
twice.  Only ids and keys are joined; a prompt travels only if it must be asked.

Replies are read as VARIANT.  What does not fit its type is told in a table beside the records: a reply
that is no object (``reply``), ``datasets`` that is no list (``datasets``), an entry that is no object
(``entry``) or has no name (``name``), a confidence that is no number (``confidence``, counted as 0), a list
field that is no list (``modalities``, ``osi_layers``, ``known_users``, counted as empty).
"""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import records
from quillspark.sources import shared

# Relationships and environments that a record may have, the default environment.
RELATIONSHIPS = ("introduced", "reused", "extended", "compared_against", "unclear")
ENVIRONMENTS = ("Physical Lab Testbed", "Real World Deployment", "Simulation")
DEFAULT_ENVIRONMENT = "Real World Deployment"
LISTS = ("modalities", "osi_layers", "known_users")
TEXTS = ("relationship_type", "availability_notes", "availability_url", "collection_environment", "evidence_text")
LEAST_TEXT = 200
TASK = "dataset_extract"

PROMPT = """List the data sets that this paper uses or introduces, as JSON: {{"datasets": [{{"name": "", "relationship_type": "",
"modalities": [], "osi_layers": [], "availability": null, "availability_url": "", "availability_notes": "",
"collection_environment": "", "known_users": [], "confidence": 0.0, "evidence_text": ""}}]}}.
Title: {title}
Authors: {authors}
Venue: {venue} {year}
DOI: {doi}
{body}"""


def prompt(template: str, **fields: Column) -> Column:
    """A template with ``{name}`` places, ``{{`` and ``}}`` for braces, filled from columns; null counts as
    empty.  A place without a column is a KeyError, before anything runs."""
    parts = []
    for told, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(told))
        if name is not None:
            parts.append(T._text(fields[name].cast("string")))
    return F.concat(*parts) if parts else F.lit("")


def attempts(template: str = PROMPT, least: int = LEAST_TEXT) -> list[tuple[str, Column]]:
    """``source, prompt`` in order for papers with ``title, authors, venue, year, doi, abstract, pdf_text``.

    The file's text counts if it has more than ``least`` characters; a paper that has one is not asked
    about by abstract or title as well.  Texts are sent whole.
    """
    text, abstract = T._text("pdf_text"), T._text("abstract")
    known = {c: F.col(c) for c in ("title", "authors", "venue", "year")} | {"doi": T.first_of(F.col("doi"), F.lit("unknown"))}
    body = lambda head, c: prompt(template, **known, body=F.concat(F.lit(f"{head}:\n"), c))
    long, told = F.length(F.trim(text)) > least, F.trim(abstract) != ""
    return [
        ("pdf_text_fallback", F.when(long, body("Text", text))),
        ("abstract", F.when(~long & told, body("Abstract", abstract))),
        ("title_only", F.when(~long & ~told, prompt(template, **known, body=F.lit("")))),
    ]


def key(asked: Column) -> Column:
    return T.content_key(F.lit(TASK), asked)


def _object(reply: Column) -> Column:
    """Whether a reply, without code fences and prose around it, is a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(T.salvage_json(reply))).startswith("OBJECT"), F.lit(False))


def replies(papers: DataFrame, tries: list[tuple[str, Column]], cache: DataFrame | None = None, ask: Callable[[Column], Column] | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``id, extraction_source, reply, error`` a paper; ``key, reply`` of what was asked, to put into the cache).

    ``papers`` has a unique ``id``.  ``cache`` has ``key, reply``.  ``ask`` maps prompts to a struct of
    ``reply, error`` (``models.replies``); without it only the cache answers.  A paper whose attempts all
    failed has its last attempt's source, a null reply and the error; one without any attempt has none.
    """
    spark = papers.sparkSession
    folder = folder or shared.new(spark, "extraction")

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}"
        if "_SUCCESS" not in shared.names(spark, path):
            df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    each = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(source).alias("source"), key(p).alias("key"), p.isNotNull().alias("has")) for n, (source, p) in enumerate(tries)))
    keys = kept(papers.select("id", F.explode(F.filter(each, lambda e: e["has"])).alias("e")).select("id", "e.n", "e.source", "e.key"), "keys")
    found = failed = asked = None
    nothing = F.lit("no reply known")
    for n, (source, p) in enumerate(tries):
        todo = keys.where(F.col("n") == n)
        if found is not None:
            todo = todo.join(found.select("id"), "id", "left_anti")
        told = None if cache is None else cache.where("reply IS NOT NULL").groupBy("key").agg(F.min("reply").alias("reply")).join(todo.select("key"), "key", "left_semi").withColumn("error", F.lit(None).cast("string"))
        if ask is not None:
            one = todo.groupBy("key").agg(F.min("id").alias("id"))
            one = one if told is None else one.join(told.select("key"), "key", "left_anti")
            said = papers.join(one, "id").select("key", ask(p).alias("a")).select("key", "a.reply", "a.error")
            said = kept(said, f"{n}-asked")
            asked = said if asked is None else asked.unionByName(said)
            told = said if told is None else told.unionByName(said)
        if told is None:
            raise ValueError("neither a cache nor a model to ask")
        now = kept(todo.join(told, "key", "left").select("id", "n", F.col("source").alias("extraction_source"), "reply", "error", _object(F.col("reply")).alias("good")), f"{n}-replies")
        good = now.where("good").select("id", "extraction_source", "reply", F.lit(None).cast("string").alias("error"))
        why = F.when(F.col("reply").isNotNull(), F.lit("reply is no JSON object")).otherwise(F.coalesce("error", nothing))
        bad = now.where("NOT good").select("id", "n", "extraction_source", F.col("reply"), why.alias("error"))
        found = good if found is None else found.unionByName(good)
        failed = bad if failed is None else failed.unionByName(bad)
    last = failed.join(found.select("id"), "id", "left_anti").groupBy("id").agg(F.max_by(F.struct("extraction_source", "error"), "n").alias("l"))
    lost = last.select("id", "l.extraction_source", F.lit(None).cast("string").alias("reply"), "l.error")
    out = papers.select("id").join(found.unionByName(lost), "id", "left")
    empty = spark.createDataFrame([], "key string, reply string")
    return out, empty if asked is None else asked.where("reply IS NOT NULL").select("key", "reply")


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID, ... of a variant; VOID of none."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("VOID"))


def entries(told: DataFrame) -> DataFrame:
    """``id, place, entry`` of replies; place -1 and no entry for a reply without a list, its ``kind`` told."""
    v = told.where("reply IS NOT NULL").select("id", F.try_parse_json(T.salvage_json("reply")).alias("v"))
    listed = v.select("id", _kind(F.col("v")).alias("whole"), _kind(F.try_variant_get("v", "$.datasets", "variant")).alias("kind"), F.try_variant_get("v", "$.datasets", "array<variant>").alias("list"))
    return listed.select("id", "whole", "kind", F.posexplode_outer("list").alias("place", "entry")).withColumn("place", F.coalesce("place", F.lit(-1)))


def _typed(each: DataFrame) -> DataFrame:
    item = lambda name, kind: F.try_variant_get("entry", f"$.{name}", kind)
    free = item("availability", "variant")
    kind = _kind(free)
    truth = F.when(kind == "BOOLEAN", item("availability", "boolean")).when(kind == "STRING", item("availability", "string") != "").when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), item("availability", "double") != 0)
    fields = {c: T._text(item(c, "string")) for c in TEXTS} | {c: item(c, "array<string>") for c in LISTS} | {f"_{c}": _kind(item(c, "variant")) for c in LISTS}
    fields |= {"name": F.trim(T._text(item("name", "string"))), "confidence": item("confidence", "double"), "_confidence": _kind(item("confidence", "variant")), "availability": truth, "_entry": _kind(F.col("entry"))}
    return each.withColumns(fields).withColumns({c: F.trim(c) for c in ("availability_notes", "availability_url", "evidence_text")})


def datasets(told: DataFrame) -> DataFrame:
    """Records that pass, cleaned: ``id, place, name, relationship_type, modalities, osi_layers, availability, ...``.

    A truth that is written as a word counts as true unless it is empty, as a model's free words do.
    """
    one = _typed(entries(told)).where((F.col("_entry") == "OBJECT") & (F.col("name") != "")).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    # an unknown relationship is put right before the rule of acceptance reads it
    sound = records.clean(one.where(records.accepted(F.col("name"), F.trim("relationship_type"), F.col("confidence"))), RELATIONSHIPS, ENVIRONMENTS, DEFAULT_ENVIRONMENT)
    return sound.select("id", "place", "name", "relationship_type", *LISTS, "availability", "availability_url", "availability_notes", "collection_environment", "confidence", "evidence_text")


def quarantine(told: DataFrame) -> DataFrame:
    """``id, place, reason, entry`` (as JSON) of what did not fit, a row for each reason."""
    each = _typed(entries(told))
    is_entry, is_object = F.col("place") >= 0, F.col("_entry") == "OBJECT"
    no_list = lambda c: ~F.col(f"_{c}").isin("ARRAY", "VOID")
    reasons = [
        ("reply", F.col("whole") != "OBJECT"),
        ("datasets", (F.col("whole") == "OBJECT") & ~F.col("kind").isin("ARRAY", "VOID")),
        ("entry", is_entry & ~is_object),
        ("name", is_object & (F.col("name") == "")),
        ("confidence", is_object & (F.col("_confidence") != "VOID") & F.col("confidence").isNull()),
        *((c, is_object & no_list(c)) for c in LISTS),
    ]
    why = F.array_compact(F.array(*(F.when(wrong, name) for name, wrong in reasons)))
    return each.select("id", "place", F.explode(why).alias("reason"), F.to_json("entry").alias("entry"))


def addresses(found: DataFrame) -> DataFrame:
    """Fills a record's address from its notes where it has neither address nor a known availability."""
    noted = F.regexp_replace(F.regexp_extract("availability_notes", r"https?://\S+", 0), r"[.,)]+$", "")
    return found.withColumn("availability_url", F.when((F.col("availability_url") == "") & F.col("availability").isNull(), noted).otherwise(F.col("availability_url")))
