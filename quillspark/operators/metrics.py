"""Counts and scores of predicted against curated papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.unicode import let


def ratio(x: Column, of: Column) -> Column:
    """x / of, 0 where ``of`` is 0."""
    return F.when(of == 0, 0.0).otherwise(x.cast("double") / F.nullif(of, F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared entries over all entries of two arrays without repeats, each built once; 0 for two empty ones."""

    def of(both: Column) -> Column:
        shared = F.size(F.array_intersect(both["a"], both["b"]))
        return ratio(shared, F.size(both["a"]) + F.size(both["b"]) - shared)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def with_scores(counts: DataFrame, scope_to_universe: bool = False) -> DataFrame:
    """Adds jaccard, precision, recall and f1, to four digits, to ``tp, fp, fn`` counts."""
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("fn_missed") if scope_to_universe else F.col("fn")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    return counts.withColumns({"jaccard": F.round(ratio(tp, tp + fp + fn), 4), "precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(f1, 4)})


def rollup(rows: DataFrame, venue: str = "venue", year: str = "year", scope_to_universe: bool = False) -> DataFrame:
    """Scores for each venue and year, each venue, and over all, from summed counts.

    ``level`` is 0, 1 or 3: none, the year, or both are rolled up.
    """
    names = [c for c in ("tp", "fp", "fn", "fn_missed", "fn_missing_from_universe") if c in rows.columns]
    sums = rows.rollup(venue, year).agg(F.grouping_id().cast("bigint").alias("level"), *(F.sum(c).cast("bigint").alias(c) for c in names))
    return with_scores(sums, scope_to_universe)


def confusion(universe: DataFrame, *keys: str, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    p, g = F.coalesce(F.col(predicted), F.lit(False)), F.coalesce(F.col(gold), F.lit(False))
    return universe.groupBy(*keys).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))


def under_curated(counts: DataFrame, excluded: DataFrame | None, min_gold: int, venue: str = "venue", year: str = "year") -> DataFrame:
    """Adds ``reason``: excluded, below_min_gold or null, from ``gold_count``."""
    low = F.lit(min_gold > 0) & (F.col("gold_count") < min_gold)
    if excluded is None:
        return counts.withColumn("reason", F.when(low, "below_min_gold"))
    marked = counts.join(excluded.select(venue, year).distinct().withColumn("_out", F.lit(True)), [venue, year], "left")
    return marked.withColumn("reason", F.when(F.col("_out"), "excluded").when(low, "below_min_gold")).drop("_out")


def ignored_gold(gold: DataFrame, classified: DataFrame, venue: str = "venue", year: str = "year") -> DataFrame:
    """Curated venue-years that were never classified, with their papers' number."""
    return gold.join(classified.select(venue, year).distinct(), [venue, year], "left_anti").groupBy(venue, year).agg(F.count("*").alias("papers"))


def presence(papers: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(overall, by source): whether both sides, one or none have data sets for matched papers."""
    m, p = F.col("manual_has"), F.col("pipeline_has")
    counts = [F.count("*").alias("total"), F.count_if(m & p).alias("both"), F.count_if(m & ~p).alias("manual_only"), F.count_if(~m & p).alias("pipeline_only"), F.count_if(~m & ~p).alias("neither")]
    told = papers.agg(*counts).withColumns({"tp": F.col("both"), "fp": F.col("pipeline_only"), "fn": F.col("manual_only")})
    by = papers.groupBy(source).agg(*counts).withColumn("recall", F.round(ratio(F.col("both"), F.col("both") + F.col("manual_only")), 4))
    return with_scores(told).drop("tp", "fp", "fn"), by
