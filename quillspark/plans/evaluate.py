"""Scoring of classified against curated papers, venue-year by venue-year."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import classify, match, metrics

KEY = ["_v", "_y"]


@dataclass(frozen=True)
class Report:
    """``instances`` are scored; ``under_curated`` and ``ignored_gold`` are told of apart."""

    rollup: DataFrame
    instances: DataFrame
    mismatches: DataFrame
    under_curated: DataFrame
    ignored_gold: DataFrame


def _refs(df: DataFrame) -> DataFrame:
    year = F.coalesce(T.year_number(F.col("year").cast("string")).cast("string"), F.trim(T._text(F.col("year").cast("string"))))
    refs = df.withColumns({"_v": F.lower(F.trim(T._text("venue"))), "_y": year, "id": F.col("ord"), "shown": F.col("title")})
    return refs.withColumns({"title": T.normalize_title("shown"), "doi": T.normalize_doi("doi")})


def evaluate(classified: DataFrame, gold: DataFrame, strictness: str = "high", drop_workshops: bool = False, fuzzy: float = match.FUZZY, excluded: DataFrame | None = None, min_gold: int = 0) -> Report:
    """Both sides have ``ord, title, doi, venue, year``; classified rows have a ``label`` too.

    Curated papers that no positive row matches are missed if another classified row of the
    venue-year matches them, else missing from the universe; ``drop_workshops`` leaves the latter
    out of the scores.
    """
    if drop_workshops and classified.where("label is not null").isEmpty():
        raise ValueError("without labels the files do not show the whole universe")
    universe, curated = _refs(classified), _refs(gold)
    curated = curated.join(universe.select(*KEY).distinct(), KEY, "left_semi")
    positive = universe.where(classify.passes(F.col("label"), strictness))
    first = match.cascade(positive, curated, KEY, fuzzy)
    missed = first.where("stage = 'right_only'").select(*KEY, F.col("right_id").alias("id")).join(curated, [*KEY, "id"])
    second = match.cascade(missed, universe, KEY, fuzzy).where("left_id is not null")
    n = lambda c: F.count_if(c).cast("bigint")
    one = first.groupBy(*KEY).agg(n(F.col("left_id").isNotNull() & F.col("right_id").isNotNull()).alias("tp"), n(F.col("stage") == "left_only").alias("fp"), n(F.col("stage") == "right_only").alias("fn"))
    two = second.groupBy(*KEY).agg(n(F.col("right_id").isNotNull()).alias("fn_missed"), n(F.col("right_id").isNull()).alias("fn_missing_from_universe"))
    shown = universe.groupBy(*KEY).agg(F.min_by("venue", "ord").alias("venue"), F.min_by(F.col("year").cast("string"), "ord").alias("year"))
    size = curated.groupBy(*KEY).agg(F.count("*").alias("gold_count"))
    counts = shown.join(one, KEY, "left").join(two, KEY, "left").join(size, KEY, "left").na.fill(0, ["tp", "fp", "fn", "fn_missed", "fn_missing_from_universe", "gold_count"])
    out = None if excluded is None else excluded.select(F.lower(F.trim("venue")).alias("_v"), F.trim(F.col("year").cast("string")).alias("_y"))
    marked = metrics.under_curated(counts, out, min_gold, *KEY)
    kept = marked.where("reason is null").drop("reason", "gold_count")
    titles = first.where("stage = 'left_only'").join(universe.select(F.col("id").alias("left_id"), "shown"), "left_id").select(*KEY, F.lit("false_positive").alias("kind"), F.col("shown").alias("title"))
    told = second.join(curated.select(F.col("id").alias("left_id"), "shown"), "left_id").select(*KEY, F.when(F.col("right_id").isNull(), "missing_from_universe").otherwise("classifier_miss").alias("kind"), F.col("shown").alias("title"))
    ignored = metrics.ignored_gold(_refs(gold), universe, *KEY)
    scored = lambda d: metrics.with_scores(d, drop_workshops).drop(*KEY)
    return Report(metrics.rollup(kept, scope_to_universe=drop_workshops), scored(kept), titles.unionByName(told), scored(marked.where("reason is not null")), ignored)
