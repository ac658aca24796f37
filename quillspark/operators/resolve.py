"""Data set records that stand for the same thing: shared links, similar names, components.

Records have ``ord, name, keys`` (the papers that cite them) and, as needed, ``modalities,
osi_layers, environment, availability_url, availability_notes, doi``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.similarity import ratio
from quillspark.operators import alike
from quillspark.operators.match import pick
from quillspark.sources import shared

MERGE_FROM = 0.85


def _keys(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))


def _links(records: DataFrame) -> DataFrame:
    """``ord, name, keys, url`` for each record and link or DOI of it."""
    doi = F.lower(F.trim(F.coalesce(F.col("doi"), F.lit(""))))
    links = F.transform(T.urls(F.coalesce("availability_url", F.lit("")), F.coalesce("availability_notes", F.lit(""))), T.normalize_url)
    every = F.concat(F.filter(links, lambda u: u != ""), F.when(doi != "", F.array(F.concat(F.lit("doi:"), doi))).otherwise(F.array().cast("array<string>")))
    return records.select("ord", "name", _keys("keys").alias("keys"), F.explode(F.array_distinct(every)).alias("url"))


def url_pairs(records: DataFrame) -> DataFrame:
    """Pairs of records that share a link or DOI and not all papers; one for each pair of names."""
    at = _links(records)
    # the first record of a name, and its first one with other papers, hold the first pair with any other name
    firsts = at.groupBy("url", "name", "keys").agg(F.min("ord").alias("ord"))
    few = firsts.withColumn("n", F.row_number().over(Window.partitionBy("url", "name").orderBy("ord"))).where("n <= 2")
    a, b = (few.select("url", *(F.col(c).alias(f"{c}_{s}") for c in ("ord", "name", "keys"))) for s in "ab")
    met = a.join(b, "url").where((F.col("ord_a") < F.col("ord_b")) & (F.col("keys_a") != F.col("keys_b")))
    met = met.withColumns({"low": F.least("name_a", "name_b"), "high": F.greatest("name_a", "name_b")})
    one = pick(met, ["low", "high"], [F.col("ord_a"), F.col("ord_b"), F.col("url")])
    return one.select("ord_a", "ord_b", "name_a", "name_b", F.lit(0.95).alias("confidence"), F.concat(F.lit("shared URL: "), "url").alias("reason"), F.lit("url_dedup").alias("method"))


def url_star(records: DataFrame) -> DataFrame:
    """``name_a, name_b, confidence``: names joined as by ``url_pairs``, by one edge a name and link.

    Where a link's records have two sets of papers or more, each record is paired with those of the other
    sets, so all its names hang together and an edge from the least name to each other one says as much.
    Null names take no part; a name is no edge with itself.
    """
    at = _links(records).where("name IS NOT NULL").groupBy("url", "name").agg(F.min("keys").alias("low"), F.max("keys").alias("high"))
    least = at.groupBy("url").agg(F.min("name").alias("name_a"), F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1 AND low <> high").select("url", "name_a")
    edges = at.select("url", F.col("name").alias("name_b")).join(least, "url").where("name_a <> name_b").select("name_a", "name_b")
    return edges.distinct().withColumn("confidence", F.lit(0.95))


def _flagged(pairs: DataFrame) -> DataFrame:
    best = F.round(F.greatest("name_ratio", "combined_ratio") * 0.8, 3)
    reason = F.format_string("name=%.2f combined=%.2f", "name_ratio", "combined_ratio")
    return pairs.select("ord_a", "ord_b", "name_a", "name_b", best.alias("confidence"), reason.alias("reason"), F.lit("similarity").alias("method"))


def similar_pairs(records: DataFrame, name_threshold: float = 0.75, combined_threshold: float = 0.70) -> DataFrame:
    """Pairs whose names or signatures have a ratio of the threshold or more.

    Either ratio bounds the lengths, so pairs are joined on lengths, first of names, then of
    signatures; only those reach Python.
    """
    base = records.select("ord", "name", _keys("keys").alias("keys"), T.record_name("name").alias("short"), T.signature(F.col("name"), F.col("modalities"), F.col("osi_layers")).alias("whole"))
    a, b = (base.select(*(F.col(c).alias(f"{c}_{s}") for c in base.columns)) for s in "ab")

    def near(column: str, t: float) -> DataFrame:
        n = F.length(f"{column}_a")
        wide = a.withColumn("size", F.explode(F.sequence(F.ceil(n * t / (2 - t) - 1e-9).cast("int"), F.floor(n * (2 - t) / t + 1e-9).cast("int"))))
        met = wide.join(b.withColumn("size", F.length(f"{column}_b")), "size").where((F.col("ord_a") < F.col("ord_b")) & (F.col("keys_a") != F.col("keys_b"))).drop("size")
        return met

    met = near("short", name_threshold).unionByName(near("whole", combined_threshold)).dropDuplicates(["ord_a", "ord_b"])
    scored = met.withColumns({"name_ratio": ratio("short_a", "short_b"), "combined_ratio": ratio("whole_a", "whole_b")})
    kept = scored.where((F.col("name_ratio") >= name_threshold) | (F.col("combined_ratio") >= combined_threshold))
    return _flagged(kept)


def without_known(similar: DataFrame, known: DataFrame) -> DataFrame:
    """Similar pairs whose names are in no known pair, the first one of each pair of names."""
    ends = {"low": F.least("name_a", "name_b"), "high": F.greatest("name_a", "name_b")}
    left = similar.withColumns(ends).join(known.withColumns(ends).select("low", "high"), ["low", "high"], "left_anti")
    return pick(left, ["low", "high"], [F.col("ord_a"), F.col("ord_b")]).drop("low", "high")


def first_similar(records: DataFrame, known: DataFrame, name_threshold: float = 0.75, combined_threshold: float = 0.70) -> DataFrame:
    """``without_known(similar_pairs(records), known)`` where many records have equal names or signatures.

    Each two different texts are compared once in each order (``alike``).  Of the records of a name and text
    the first one, or the first with other papers, begins the first pair with those of another; whether a
    record with other papers follows is told by the last one and the last with other papers.  Only for the
    first beginning of two names are the records that may follow looked through.
    """
    base = records.where("name IS NOT NULL").select("ord", "name", _keys("keys").alias("keys"), T.record_name("name").alias("short"), T.signature(F.col("name"), F.col("modalities"), F.col("osi_layers")).alias("whole"))
    whole = F.struct("ord", "keys", "short", "whole").alias("r")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("short", "whole")))
    each = shared.save(base.select("name", whole, F.explode(kinds).alias("at")).select("at.kind", "name", "at.text", "r"), "records")
    group = ["kind", "name", "text"]
    one = each.groupBy(*group).agg(F.min("r").alias("first"), F.max("r").alias("last"))
    other = lambda c: F.when(F.col("r.keys") != F.col(f"{c}.keys"), F.col("r"))
    groups = each.join(one, group).groupBy(*group, "first", "last").agg(F.min(other("first")).alias("second"), F.max(other("last")).alias("late"))
    groups = shared.save(groups, "groups")
    texts = groups.select("kind", "text").distinct()

    def near(kind: str, t: float) -> DataFrame:
        mine = texts.where(F.col("kind") == kind)
        blank = mine.where("text = ''").select("kind", F.col("text").alias("left"), F.col("text").alias("right"))  # equal, too
        return alike.pairs(mine, mine, ["kind"], t).select("kind", "left", "right").unionByName(blank)

    close = shared.save(near("short", name_threshold).unionByName(near("whole", combined_threshold)), "close")
    begins = groups.select("kind", F.col("text").alias("left"), F.col("name").alias("name_a"), F.explode(F.array_compact(F.array("first", "second"))).alias("a"))
    ends = groups.select("kind", F.col("text").alias("right"), F.col("name").alias("name_b"), "last", "late")
    follows = lambda c: (F.col(f"{c}.ord") > F.col("a.ord")) & (F.col(f"{c}.keys") != F.col("a.keys"))
    met = begins.join(close, ["kind", "left"]).join(ends, ["kind", "right"]).where(follows("last") | F.coalesce(follows("late"), F.lit(False)))
    met = met.select("kind", "right", "name_a", "name_b", "a", F.least("name_a", "name_b").alias("low"), F.greatest("name_a", "name_b").alias("high"))
    seen = known.select(F.least("name_a", "name_b").alias("low"), F.greatest("name_a", "name_b").alias("high")).distinct()
    # all that begins with the least record, in one row for each two names
    least = met.groupBy("low", "high", "a", "name_a", "name_b").agg(F.collect_set(F.struct("kind", "right")).alias("texts"))
    least = least.groupBy("low", "high").agg(F.min(F.struct("a", "name_a", "name_b", "texts")).alias("m")).join(seen, ["low", "high"], "left_anti")
    asked = least.select("low", "high", "m.a", "m.name_a", "m.name_b", F.explode("m.texts").alias("t")).select("low", "high", "a", "name_a", "name_b", "t.kind", F.col("t.right").alias("text"))
    found = asked.join(each.withColumnRenamed("name", "name_b"), ["kind", "name_b", "text"]).where(follows("r"))
    firsts = found.groupBy("low", "high").agg(F.min(F.struct("a", "r", "name_a", "name_b")).alias("m")).select("m.*")
    named = firsts.select(F.col("a.ord").alias("ord_a"), F.col("r.ord").alias("ord_b"), "name_a", "name_b", ratio("a.short", "r.short").alias("name_ratio"), ratio("a.whole", "r.whole").alias("combined_ratio"))
    return _flagged(named)


def confirmed(pairs: DataFrame, reply: Column) -> DataFrame:
    """Pairs after a model's verdict, with its reason: yes 0.90, unsure 0.70, no dropped."""
    said = pairs.withColumn("_v", T.verdict(reply)).where("_v != 'no'")
    yes = F.col("_v") == "yes"
    reason = F.concat(F.lit("LLM "), "_v", F.lit(": "), T.verdict_reason(reply))
    return said.withColumns({"reason": reason, "confidence": F.when(yes, 0.90).otherwise(0.70), "method": F.when(yes, "llm_confirmed").otherwise("llm_unsure")}).drop("_v")


def _cut(df: DataFrame, spark: SparkSession) -> DataFrame:
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillspark-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """``name, root`` for the names of ``a, b`` edges: root is the least name of the component.

    Labels spread along edges and jump to their label's label, so rounds grow with the logarithm
    of a component's diameter; lineage is cut by checkpoint() in each.  They end when no label changes,
    as one can only fall.  Edges with a null end count for nothing.
    """
    spark = edges.sparkSession
    both = _cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), spark)
    labels = both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = _cut(labels, spark)
    while True:
        seen = both.join(labels.select(F.col("name").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("name")).agg(F.min("near").alias("near"))
        step = labels.join(seen, "name").select("name", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("name").alias("root"), F.col("root").alias("far"))
        after = _cut(step.join(jump, "root", "left").select("name", "old", F.coalesce("far", "root").alias("root")), spark)
        labels = after.select("name", "root")
        if after.where("old != root").isEmpty():
            return labels


def consolidate(records: DataFrame, matches: DataFrame, merge_from: float = MERGE_FROM) -> DataFrame:
    """One row for each component of names that confident matches link.

    The name is the longest, the smallest of equally long ones.
    """
    links = matches.where(F.col("confidence") >= merge_from).select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    rooted = records.join(components(links), "name", "left").withColumn("root", F.coalesce("root", "name"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda s: s[c])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    layers = F.filter(F.split(text("osi_layers"), r"[;,\s]+"), lambda x: x != "")
    out = rooted.withColumn("_layers", layers).groupBy("root").agg(
        F.array_sort(F.collect_set("name"), lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)).alias("all_names"),
        F.array_distinct(F.flatten(ordered("keys"))).alias("keys"),
        F.max_by(text("modalities"), F.struct(F.length(text("modalities")), -F.col("ord"))).alias("modalities"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_layers")))), ", ").alias("osi_layers"),
        F.array_sort(F.filter(F.collect_set("environment"), lambda e: e != "")).alias("environments"),
        F.coalesce(F.min_by(F.nullif(text("availability_url"), F.lit("")), F.when(text("availability_url") != "", F.col("ord"))), F.lit("")).alias("availability_url"),
    )
    many = F.size("all_names")
    return out.select(
        F.element_at("all_names", 1).alias("canonical_name"), "all_names", "keys", F.size("keys").cast("bigint").alias("reuse_count"), "modalities", "osi_layers", "environments", "availability_url",
        F.when(many > 1, F.concat(F.lit("merged "), many.cast("string"), F.lit(" name variants"))).otherwise("").alias("merge_reason"),
    )
