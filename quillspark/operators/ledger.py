"""The run log and what hangs on it: ids by name, runs, pruning over all tables, reviews.

Tables are frames; each function returns the frame, or the frames, that take a table's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

BUCKETS = 1024


def get_or_create(known: DataFrame, wanted: DataFrame, keys: list[str], number: str = "id") -> DataFrame:
    """``known`` (keys and a number) with a number for each key of ``wanted`` that it lacks.

    New numbers lie above the old ones, are unique and the same at every run, but have gaps: keys are
    dealt to buckets by their hash and counted in each, so that no task sees all of them.
    """
    new = wanted.select(*keys).distinct().join(known.select(*keys), keys, "left_anti").withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    last = known.agg(F.max(number).alias("last")).first()["last"] or 0
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) - 1
    made = new.select(*keys, (F.lit(last) + place * BUCKETS + F.col("_b") + 1).cast("bigint").alias(number))
    return known.select(*keys, F.col(number).cast("bigint").alias(number)).unionByName(made)


def with_id(rows: DataFrame, known: DataFrame, keys: list[str], number: str, name: str) -> DataFrame:
    """``rows`` with the number that ``known`` has for their key; blank keys have none."""
    return rows.join(known.select(*keys, F.col(number).alias(name)), keys, "left")


def started(runs: DataFrame, instance: int, stage: str, number: int) -> DataFrame:
    """The log with a run that is under way."""
    row = runs.sparkSession.range(1).select(F.lit(number).cast("bigint").alias("id"), F.lit(instance).cast("bigint").alias("instance_id"), F.lit(stage).alias("stage"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("message"))
    return runs.select(*row.columns).unionByName(row)


def completed(runs: DataFrame, number: int, message: str) -> DataFrame:
    """The log with a run marked as completed."""
    mine = F.col("id") == number
    return runs.withColumns({"status": F.when(mine, "completed").otherwise(F.col("status")), "message": F.when(mine, message).otherwise(F.col("message"))})


def required(runs: DataFrame, number: int) -> DataFrame:
    """The run of that number; ValueError if the log lacks it."""
    found = runs.where(F.col("id") == number)
    if found.isEmpty():
        raise ValueError(f"Run {number} not found")
    return found


def already_ingested(papers: DataFrame, runs: DataFrame, instance: int) -> int | None:
    """The last ingest run of an instance that has papers, else None: then it must be read."""
    if papers.where(F.col("instance_id") == instance).isEmpty():
        return None
    return runs.where((F.col("instance_id") == instance) & (F.col("stage") == "ingest")).agg(F.max("id").alias("id")).first()["id"]


def recent(runs: DataFrame, instances: DataFrame, venues: DataFrame, most: int = 20) -> DataFrame:
    """The newest runs with venue and year; runs of no known instance are left out."""
    year = instances.select(F.col("id").alias("instance_id"), "venue_id", "year")
    named = runs.join(year, "instance_id").join(venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue")), "venue_id")
    return named.orderBy(F.desc("id")).limit(most).select("id", "venue", "year", "stage", "status")


def doomed(runs: DataFrame, instances: DataFrame, venues: DataFrame, venue: str | None = None, year: int | None = None, stage: str | None = None, number: int | None = None) -> DataFrame:
    """Runs to prune: one by its number, or those of a venue and year (of one stage)."""
    if number is not None:
        return required(runs, number)
    if not venue or year is None:
        raise ValueError("give a run's number, or a venue and a year")
    named = venues.where(F.lower("name") == venue.lower()).select(F.col("id").alias("venue_id"))
    mine = instances.where(F.col("year") == year).join(named, "venue_id", "left_semi").select(F.col("id").alias("instance_id"))
    return runs.join(mine, "instance_id", "left_semi").where(F.lit(True) if stage is None else F.col("stage") == stage)


def pruned(tables: dict[str, DataFrame], gone: DataFrame, stage: str | None = None, keep_texts: bool = True) -> dict[str, DataFrame]:
    """Every table without what the runs ``gone`` made.

    ``tables`` has ``runs``, ``papers``, ``predictions``, ``claims``, ``bibtex``, ``datasets`` and
    ``texts``.  Predictions go with runs of classify-candidates, claims and the instances' BibTeX with
    runs of extract-datasets, both with any runs if no stage was named; data sets that no claim names
    any more go always, texts only if they are not kept.
    """
    runs = gone.select(F.col("id").alias("run_id"))
    mine = tables["papers"].join(gone.select("instance_id").distinct(), "instance_id", "left_semi").select(F.col("id").alias("paper_id"))
    hit = lambda name: stage is None or not gone.where(F.col("stage") == name).isEmpty()
    out = dict(tables)
    if hit("classify-candidates"):
        out["predictions"] = tables["predictions"].join(runs, "run_id", "left_anti")
    if hit("extract-datasets"):
        out["claims"] = tables["claims"].join(runs, "run_id", "left_anti")
        out["bibtex"] = tables["bibtex"].join(mine, "paper_id", "left_anti")
    used = out["claims"].where("dataset_id IS NOT NULL").select(F.col("dataset_id").alias("id")).distinct()
    out["datasets"] = tables["datasets"].join(used, "id", "left_semi")
    if not keep_texts:
        out["texts"] = tables["texts"].join(mine, "paper_id", "left_anti")
    out["runs"] = tables["runs"].join(gone.select("id"), "id", "left_anti")
    return out


def removed(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """``table, removed``: rows that each table lost, where it lost any."""
    count = lambda d, name, sign: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), (F.col("n") * sign).alias("n"))
    parts = [count(d, name, sign) for name in sorted(before) for d, sign in ((before[name], 1), (after[name], -1))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("table").agg(F.sum("n").cast("bigint").alias("removed")).where("removed > 0")


def review_items(queue: DataFrame, items: DataFrame) -> DataFrame:
    """The review queue with new items, pending unless they say otherwise."""
    status = F.coalesce(F.nullif(T._text("status"), F.lit("")), F.lit("pending")) if "status" in items.columns else F.lit("pending")
    return queue.unionByName(items.withColumn("status", status).select(*queue.columns))


# --- venues and years ------------------------------------------------------------------------


def venue_years(gold: DataFrame) -> DataFrame:
    """The distinct venues and years of curated sheets, by lower-case venue, then year."""
    return gold.select(F.trim("venue").alias("venue"), "year").where("venue <> '' AND year IS NOT NULL").distinct().orderBy(F.lower("venue"), "year", "venue")


def ingestable(pairs: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(venue-years whose venue the registry of conferences has, the others)."""
    known, own = registry.select(F.lower(F.trim("venue")).alias("_v")).distinct(), F.lower(F.trim(pairs["venue"])) == F.col("_v")
    return pairs.join(known, own, "left_semi"), pairs.join(known, own, "left_anti")


def years(text: str) -> list[int]:
    """``2024`` or the inclusive range ``2023:2025``."""
    first, colon, last = text.strip().partition(":")
    try:
        low = int(first)
        high = int(last) if colon else low
    except ValueError:
        raise ValueError("years must be a year (2024) or a range (2023:2025)") from None
    if low > high:
        raise ValueError("a range of years must not fall")
    return list(range(low, high + 1))


def venue_year_pairs(entries: list[str]) -> list[tuple[str, str]]:
    """``VENUE:YEAR`` entries as pairs."""
    out = [(venue.strip(), year.strip()) for venue, _, year in (e.partition(":") for e in entries)]
    if not all(v and y for v, y in out):
        raise ValueError("entries must look like VENUE:YEAR")
    return out
