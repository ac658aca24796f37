"""Table changes as new tables: first or last writer wins, backfill, prune, run log, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.match import pick


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows stay; of new rows with an unused key the first one comes in."""
    return existing.unionByName(pick(new.join(existing.select(*keys).distinct(), keys, "left_anti"), keys, [F.col(order).asc()]).select(*existing.columns))


def insert_or_replace(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows take the place of rows with their key; of equal new keys the last one counts."""
    kept = existing.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(pick(new, keys, [F.col(order).desc()]).select(*existing.columns))


def backfill(rows: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Fills blank columns from a lookup with one row for each key."""
    side = found.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in columns}
    return rows.join(side, keys, "left").withColumns(filled).drop(*(f"_{c}" for c in columns))


def prune(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(doomed.select(*keys).distinct(), keys, "left_anti")


def orphans(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents that no child names."""
    used = children.where(F.col(child_key).isNotNull()).select(F.col(child_key).alias(key)).distinct()
    return parents.join(used, key, "left_anti")


def latest(runs: DataFrame, keys: list[str], number: str = "id") -> DataFrame:
    return pick(runs, keys, [F.col(number).desc()])


def evidence(claims: DataFrame, run_id: Column) -> DataFrame:
    """Evidence rows to append: a generated id and the run beside each claim."""
    return claims.withColumns({"claim_id": F.uuid(), "run_id": run_id, "created_at": F.current_timestamp()})


# --- lookups through a key-value cache -----------------------------------------------------------


def cache_put(cache: DataFrame, papers: DataFrame, value: str) -> DataFrame:
    """Writes a value under a paper's DOI key and its title key; later writes win."""
    keys = F.array(F.when(T._text("doi") != "", T.doi_key("doi")), F.when(T.guard_title("title") != "", T.title_key("title")))
    new = papers.select(F.explode(F.array_compact(keys)).alias("key"), F.col(value).alias("value"), "ord")
    return insert_or_replace(cache.select("key", "value"), new, ["key"], "ord")


def cache_get(papers: DataFrame, cache: DataFrame, name: str) -> DataFrame:
    """Adds the value under the DOI key, else under the title key."""
    side = lambda k, v: cache.select(F.col("key").alias(k), F.col("value").alias(v))
    keyed = papers.withColumns({"_dk": T.doi_key("doi"), "_tk": T.title_key("title")})
    return keyed.join(side("_dk", "_dv"), "_dk", "left").join(side("_tk", "_tv"), "_tk", "left").withColumn(name, F.coalesce("_dv", "_tv")).drop("_dk", "_tk", "_dv", "_tv")


def fresh(cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Entries not older than ``days``; a stamp that cannot be read counts as fresh."""
    stored = F.try_to_timestamp("stored_at")
    return cache.where(stored.isNull() | (stored >= now - F.make_interval(days=F.lit(days))))


def without_section(cache: DataFrame, section: str, known: tuple[str, ...]) -> DataFrame:
    if section not in known:
        raise ValueError(f"unknown section {section}: one of {', '.join(known)}")
    return cache.where(F.col("section") != section)


def sections(cache: DataFrame) -> DataFrame:
    """``section, entries``: how many entries each section of the cache has."""
    return cache.groupBy("section").agg(F.count("*").alias("entries"))


def cleared(cache: DataFrame, known: tuple[str, ...], section: str | None = None) -> tuple[DataFrame, int]:
    """The cache without one section, or empty, and how many entries went."""
    kept = cache.limit(0) if section is None else without_section(cache, section, known)
    gone = cache if section is None else cache.where(F.col("section") == section)
    return kept, gone.count()


def real_abstract(abstract: Column, provider: Column) -> Column:
    """Whether a cache entry holds an abstract: not blank, and no remembered miss."""
    return F.coalesce((T._text(abstract) != "") & ~provider.eqNullSafe(F.lit("miss")), F.lit(False))


def load_cache(spark, path: str, known: tuple[str, ...]) -> DataFrame:
    """``section, key, value`` (JSON) of the JSON files at ``path``, one object of sections to a file.

    A file that is no JSON object and entries that are no objects are passed over.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("top"))
    parts = whole.select(F.explode("top").alias("section", "body")).where(F.col("section").isin(*known))
    entries = parts.select("section", F.explode(F.from_json("body", "map<string, string>")).alias("key", "value"))
    return entries.where(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull())
