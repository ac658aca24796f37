"""The merged list of data sets, kept up to date run by run instead of being merged anew.

A store has for each normal form of a name what every run (a venue and year, say) contributes: its first
spelling, its sheet's numbers, the first key, and how many of its papers have it.  All of these merge over
runs and can be taken back, so a run that is added, made again or dropped touches the names that it had or
has, and only their buckets.  The merged list is read row by row, without a shuffle.

A name's row grows with the runs that have it, not with their papers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources import shared, versions

SLOTS = 64  # rows in which the store lists a run's names
PART = "struct<run: string, first: struct<ord: bigint, name: string>, papers: bigint, summed: bigint, key: struct<ord: bigint, key: string>>"


def partials(records: DataFrame, sheets: DataFrame) -> DataFrame:
    """``norm, part`` for each run and name.

    ``records`` has ``run, paper, ord, name``, ``sheets`` has ``run, ord, name, key, number``.  Blank names count
    in neither; a number that is none counts as nothing, a run null as the run named by an empty string.
    """
    run, norm, ord_ = T._text("run").alias("run"), T.merge_name("name").alias("norm"), F.col("ord").cast("bigint")
    seen = records.where(F.trim(T._text("name")) != "").groupBy(run, norm).agg(F.min(F.struct(ord_.alias("ord"), "name")).alias("first"), F.count_distinct("paper").alias("papers"))
    key = F.when(T._text("key") != "", F.struct(ord_.alias("ord"), F.col("key").alias("key")))
    told = sheets.where(F.trim(T._text("name")) != "").groupBy(run, norm).agg(F.min(F.struct(ord_.alias("ord"), "name")).alias("listed"), F.sum(F.col("number").try_cast("bigint")).alias("summed"), F.min(key).alias("key"))
    # a name that only a sheet has counts one paper, as its list has it
    both = seen.join(told, ["run", "norm"], "full").select("norm", "run", F.coalesce("first", "listed").alias("first"), F.coalesce("papers", F.lit(0)).alias("papers"), "summed", "key")
    return both.select("norm", F.struct("run", "first", "papers", "summed", "key").cast(PART).alias("part"))


def _places(keys: DataFrame, columns: list[str], buckets: int) -> list[int]:
    """The buckets of keys: as many numbers as a table has buckets, at most."""
    return sorted(r[0] for r in keys.select(F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int").alias("k")).distinct().collect())


def _slot(norm: Column) -> Column:
    return F.pmod(F.xxhash64(norm), F.lit(SLOTS)).cast("int")


def replace(spark: SparkSession, path: str, runs: DataFrame, records: DataFrame, sheets: DataFrame, buckets: int = versions.BUCKETS) -> list[int]:
    """Puts what ``records`` and ``sheets`` tell of ``runs`` (``run``) in the place of what the store had of them, in
    one commit, and gives the buckets of names that it touched.

    A run that neither has any more is dropped.  Rows of runs that are not in ``runs`` are left out.
    """
    chosen = shared.save(runs.select(T._text("run").alias("run")).distinct(), "runs")
    only = lambda df: df.withColumn("run", T._text("run")).join(chosen, "run", "left_semi")
    new = shared.save(partials(only(records), only(sheets)), "partials")
    slots = chosen.select("run", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    touched: list[int] = []

    def make(c: versions.Change) -> None:
        names = new.select("norm")
        if c.has("runs"):
            was = c.read("runs", _places(slots, ["run", "slot"], c.tables["runs"]["buckets"])).join(chosen, "run", "left_semi")
            names = names.unionByName(was.select(F.explode("norms").alias("norm")))
        names = shared.save(names.distinct(), "names")
        size = c.tables["names"]["buckets"] if c.has("names") else buckets
        touched[:] = _places(names, ["norm"], size)
        mine = new.groupBy("norm").agg(F.collect_list("part").alias("mine"))
        now = names.join(mine, "norm", "left")
        none = F.array().cast(f"array<{PART}>")
        kept = none
        if c.has("names"):
            # what other runs tell of these names: theirs minus the chosen runs
            old = c.read("names", touched).join(names, "norm", "left_semi").select("norm", F.explode("parts").alias("part"))
            others = old.join(chosen, F.col("part.run") == chosen.run, "left_anti").groupBy("norm").agg(F.collect_list("part").alias("kept"))
            now, kept = now.join(others, "norm", "left"), F.coalesce("kept", none)
        after = shared.save(now.select("norm", F.array_sort(F.concat(kept, F.coalesce("mine", none))).alias("parts")), "after")
        c.upsert("names", after.where("size(parts) > 0"), ["norm"], "norm", buckets)
        c.remove("names", after.where("size(parts) = 0"), ["norm"])
        listed = new.select(F.col("part.run").alias("run"), _slot(F.col("norm")).alias("slot"), "norm").groupBy("run", "slot").agg(F.collect_list("norm").alias("norms"))
        empty = F.array().cast("array<string>")
        c.upsert("runs", slots.join(listed, ["run", "slot"], "left").select("run", "slot", F.coalesce("norms", empty).alias("norms")), ["run", "slot"], "run", 16)

    versions.change(spark, path, make)
    return touched


def merged(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """``name, key, summed, papers``: the first spelling over all runs by name, the first key that is not
    blank, the sheets' numbers together, and the papers (one, if only sheets have the name)."""
    parts = versions.snapshot(spark, path)["names"].select("parts")
    first = lambda c: F.array_min(F.transform(F.filter("parts", lambda p: p[c].isNotNull()), lambda p: F.struct(p["run"].alias("run"), p[c].alias("v"))))["v"]
    added = lambda c: F.aggregate(F.filter(F.transform("parts", lambda p: p[c]), lambda x: x.isNotNull()), F.lit(None).cast("bigint"), lambda a, x: F.coalesce(a, F.lit(0).cast("bigint")) + x)
    papers = F.greatest(F.coalesce(added("papers"), F.lit(0)), F.lit(1))
    out = parts.select(first("first")["name"].alias("name"), F.coalesce(first("key")["key"], F.lit("")).alias("key"), added("summed").alias("summed"), papers.cast("bigint").alias("papers"))
    return out.where(F.col("papers") >= least)
