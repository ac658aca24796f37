"""Acceptance, cleaning, counting and merging of extracted data set records and paper sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.match import pick

# Names that describe instead of naming, relationships, layers, environments.
GARBAGE_STARTS = ("figure ", "fig.", "fig ", "table ", "our ", "the ", "this ", "same ", "a ", "an ", "some ", "collected ", "recorded ", "running ")
GARBAGE_NAMES = (
    "data", "dataset", "trace", "traces", "log", "logs", "test", "testbed", "pcap", "pings", "artifact", "training set",
    "speed test", "testing dataset", "training sets", "collected traces", "real-world traces", "performance tests",
    "open-source code and data",
)
FIGURE_STARTS = ("figure ", "fig.", "fig ", "table ")
LAYERS = ("L1", "L2", "L3", "L4", "L5", "L6", "L7")
INTRODUCED, OTHERS = 0.60, 0.50


def _starts(x: Column, heads: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for head in heads:
        out = out | x.startswith(head)
    return out


def garbage(name: Column) -> Column:
    """Names that read as descriptions."""
    low = F.trim(F.lower(name))
    return _starts(low, GARBAGE_STARTS) | low.isin(*GARBAGE_NAMES) | (name == F.lower(name)) & (F.length(name) > 60) | name.rlike(r"^\d[\d,.]+ ") & (F.length(name) > 20)


def accepted(name: Column, relationship: Column, confidence: Column) -> Column:
    """Introduced data sets pass from 0.60 unless their name is a figure or generic; others from
    0.50 with a name that is no garbage."""
    name, low = F.trim(T._text(name)), F.trim(F.lower(T._text(name)))
    confidence = F.coalesce(confidence, F.lit(0.0))
    own = (confidence >= INTRODUCED) & (name.rlike(r"^[A-Z][a-z]+\d{4}-") | ~(_starts(low, FIGURE_STARTS) | low.isin(*GARBAGE_NAMES)))
    return (name != "") & F.when(F.lower(T._text(relationship)) == "introduced", own).otherwise((confidence >= OTHERS) & ~garbage(name))


def clean(records: DataFrame, relationships: tuple[str, ...], environments: tuple[str, ...], default_environment: str) -> DataFrame:
    """Trims lists, keeps known layers, and puts unknown relationships and environments right."""
    trimmed = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    relationship, place = F.lower(T._text("relationship_type")), F.trim(T._text("collection_environment"))
    return records.withColumns(
        {
            "name": F.trim(T._text("name")),
            "relationship_type": F.when(relationship.isin(*relationships), relationship).otherwise("unclear"),
            "modalities": trimmed("modalities"),
            "osi_layers": F.filter(F.transform(trimmed("osi_layers"), F.upper), lambda x: x.isin(*LAYERS)),
            "collection_environment": F.when(place.isin(*environments), place).otherwise(default_environment),
            "known_users": F.slice(trimmed("known_users"), 1, 5),
        }
    )


def usage_counts(records: DataFrame, venue: str = "venue", year: str = "year", name: str = "name") -> DataFrame:
    """Writes on each record how many records of its venue-year have its name.

    Counts are aggregated first and joined back, so a very common name is no single task's work.
    """
    counts = records.groupBy(venue, year, name).agg(F.count("*").alias("usage_count"))
    return records.join(counts, [venue, year, name])


def datasets_sheet(records: DataFrame, attributes: list[str]) -> DataFrame:
    """For each name the first record's attributes, the number of records, and the key of the
    first paper that introduced it, else of the first paper."""
    introduced = F.col("relationship_type") == "introduced"
    first = F.min_by(F.struct(*attributes), F.col("ord"))
    out = records.groupBy("name").agg(first.alias("f"), F.count("*").alias("paper_count"), F.min_by("key", "ord").alias("first_key"), F.min_by("key", F.when(introduced, F.col("ord"))).alias("introducing_key"))
    return out.select("name", *(F.col(f"f.{a}").alias(a) for a in attributes), "paper_count", F.coalesce(F.nullif("introducing_key", F.lit("")), "first_key").alias("key"))


def corpus_counts(records: DataFrame) -> DataFrame:
    """Papers for each normalised name, and its first spelling."""
    return records.where(F.col("name") != "").groupBy(T.merge_name("name").alias("norm")).agg(F.count_distinct("paper").alias("papers"), F.min_by("name", "ord").alias("canonical"))


def merge_sheets(sheet: DataFrame, counts: DataFrame, least: int = 1) -> DataFrame:
    """Rows of data set sheets merged by name: ``name, key, summed, papers``.

    Names with one normal form become its first spelling in the corpus; ``summed`` adds the sheets'
    own numbers, ``papers`` is the corpus count (1 if the corpus lacks the name).
    """
    number = F.col("number").try_cast("bigint")
    joined = sheet.withColumn("norm", T.merge_name("name")).join(counts, "norm", "left").withColumn("final", F.coalesce("canonical", "name"))
    out = joined.groupBy("final").agg(F.sum(number).cast("bigint").alias("summed"), F.min_by("key", F.when(F.coalesce("key", F.lit("")) != "", F.col("ord"))).alias("key"), F.coalesce(F.max("papers"), F.lit(1)).alias("papers"))
    return out.where(F.col("papers") >= least).select(F.col("final").alias("name"), F.coalesce("key", F.lit("")).alias("key"), "summed", "papers")


def first_wins(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    return pick(rows, [key], [F.col(order).asc()])


def last_wins(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    return pick(rows, [key], [F.col(order).desc()])


def review(seeds: DataFrame, threshold: float = 0.90) -> DataFrame:
    """``reason, title, confidence``: seeds without title or authors, doubtful ones, and titles
    that several seeds have."""
    row = lambda d, reason: d.select(F.lit(reason).alias("reason"), "title", "confidence")
    plain = F.lower(T.squash("title"))
    double = seeds.groupBy(plain.alias("title")).count().where("count > 1 and title != ''").select(F.lit("duplicate_title").alias("reason"), "title", F.lit(0.50).alias("confidence"))
    return (
        row(seeds.where(F.trim(T._text("title")) == ""), "missing_title")
        .unionByName(row(seeds.where(F.size(F.coalesce("authors", F.array().cast("array<string>"))) == 0), "missing_authors"))
        .unionByName(row(seeds.where(F.col("confidence") < threshold), "low_confidence"))
        .unionByName(double)
    )


NON_PAPER = (
    r"^\s*(?:poster|demo|demonstration|work[\s-]?in[\s-]?progress|wip|tutorial|keynote|panel|invited\s+(?:talk|paper|speaker)"
    r"|extended\s+abstract|abstract|short\s+paper|birds[\s-]of[\s-]a[\s-]feather|bof|workshop\s+(?:summary|report)|session\s+details"
    r"|front\s+matter|table\s+of\s+contents|proceedings\s+of)\b\s*[:\-–—]"
)  # Fixed value: leading marks of entries that are no papers.


def non_paper(title: Column, pattern: str = NON_PAPER) -> Column:
    return T._text(title).rlike("(?i)" + pattern)


def carried(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null, up to each row."""
    spec = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(spec))


def zipped(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The n-th row of one side beside the n-th of the other, within keys."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return left.withColumn("n", n).join(right.withColumn("n", n).drop(order), [*keys, "n"], "left")
