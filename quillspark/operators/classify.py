"""Keyword labels of papers, label breakdowns, and labels from a model through a cache."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

# The default vocabularies.
WIRELESS = (
    "5g", "6g", "802.11", "antenna", "backscatter", "base station", "beamforming", "bluetooth", "cellular",
    "channel state information", "csi", "lora", "lorawan", "lte", "mac layer", "mimo", "mmwave", "ofdm", "phy", "radio",
    "ran", "rf", "rssi", "rsrp", "rsrq", "satellite", "sinr", "spectrum", "uwb", "wi-fi", "wifi", "wireless", "zigbee",
)
NETWORKING = (
    "bandwidth", "congestion", "datacenter", "data center", "edge", "internet", "latency", "middlebox", "network",
    "packet", "routing", "sdn", "tcp", "traffic", "transport protocol", "wan",
)
COMPUTING = (
    "compiler", "database", "distributed system", "file system", "gpu", "kernel", "machine learning",
    "operating system", "storage",
)
SPELLINGS = (("wi fi", "wifi"), ("wi-fi", "wifi"), ("mm-wave", "mmwave"), ("millimeter wave", "mmwave"))


@dataclass(frozen=True)
class Vocabulary:
    wireless: tuple[str, ...] = WIRELESS
    networking: tuple[str, ...] = NETWORKING
    computing: tuple[str, ...] = COMPUTING


def _spelt(term: str) -> str:
    term = term.lower()
    for old, new in SPELLINGS:
        term = term.replace(old, new)
    return re.sub(r"\s+", " ", term)


def normalized(x: Column) -> Column:
    out = F.lower(x)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, T.WS, " ")


def matched(text: Column, terms: tuple[str, ...]) -> Column:
    """Terms that a text holds as words (terms with a dot: anywhere), sorted."""
    found = []
    for term in sorted(terms):
        own = _spelt(term)
        hit = text.contains(own) if "." in own else text.rlike(rf"\b{re.escape(own)}\b")
        found.append(F.when(hit, F.lit(term)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def keyword(papers: DataFrame, vocabulary: Vocabulary = Vocabulary(), title: str = "title", abstract: str = "abstract") -> DataFrame:
    """Adds ``label, confidence, category, evidence, used_abstract`` to papers."""
    whole = F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(abstract), F.lit("")))
    seen = papers.withColumn("_text", normalized(whole))
    for name, terms in (("_w", vocabulary.wireless), ("_n", vocabulary.networking), ("_c", vocabulary.computing)):
        seen = seen.withColumn(name, matched(F.col("_text"), terms))
    w, n, c = (F.size(x) > 0 for x in ("_w", "_n", "_c"))
    has = F.coalesce(F.col(abstract), F.lit("")) != ""
    told = lambda name, x: F.when(F.size(x) > 0, F.concat(F.lit(f"{name}="), F.array_join(x, ", ")))
    category = F.when(w, "wireless").when(n, "networking_non_wireless").when(c, "not_relevant").otherwise("uncertain")
    confidence = (
        F.when(w, F.least(F.lit(0.98), F.element_at(F.array(F.lit(0.93), F.lit(0.95), F.lit(0.97)), F.greatest(F.least(F.size("_w"), F.lit(3)), F.lit(1)))))
        .when(n, F.when(has, 0.82).otherwise(0.70))
        .when(c, F.when(has, 0.76).otherwise(0.65))
        .otherwise(F.when(has, 0.55).otherwise(0.45))
    )
    evidence = F.concat_ws("; ", F.concat(F.lit("category="), category), told("wireless_terms", "_w"), told("networking_terms", "_n"), told("computing_terms", "_c"), F.when(~has, "abstract_missing=true"))
    return seen.withColumns(
        {
            "label": F.when(w, "yes").when(n | c, "no").otherwise("maybe"),
            "confidence": confidence,
            "category": category,
            "evidence": evidence,
            "used_abstract": F.trim(F.coalesce(F.col(abstract), F.lit(""))) != "",
        }
    ).drop("_text", "_w", "_n", "_c")


def passes(label: Column, strictness: str = "high") -> Column:
    """Positive labels: yes, or with low strictness also maybe; rows without a label are positive."""
    kept = {"high": ("yes",), "low": ("yes", "maybe")}[strictness]
    return label.isin(*kept) | label.isNull()


def to_extract(papers: DataFrame, labels: DataFrame, strictness: str = "low") -> DataFrame:
    """Papers to extract from: positive labels, and those that the classifier gave none."""
    one = labels.groupBy("id").agg(F.max(F.when(passes(F.col("label"), strictness), 1).otherwise(0)).alias("_keep"))
    return papers.join(one.where("_keep = 0").select("id"), "id", "left_anti")


def breakdown(labelled: DataFrame, *keys: str) -> DataFrame:
    """Counts and shares of labels for each key and, by rollup, over all; ``level`` counts the
    keys that are rolled up."""
    n = lambda c: F.count_if(c).cast("bigint")
    out = labelled.rollup(*keys).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count("*").cast("bigint").alias("total"),
        *(n(F.col("label") == x).alias(x) for x in ("yes", "maybe", "no")),
        n(F.col("used_abstract")).alias("with_abstract"),
    )
    return out.withColumns({f"{x}_pct": F.round(F.col(x) * 100.0 / F.col("total"), 1) for x in ("yes", "maybe", "no")})


def with_cache(papers: DataFrame, cache: DataFrame, model: Callable[[Column], Column], prompt: Column, provider: str, name: str, refresh: bool = False) -> DataFrame:
    """Labels by a model: cached replies by content key, others from ``model(prompt)``, which is asked
    once for each prompt that the cache lacks, however many papers have it.

    ``cache`` has ``key, label, confidence``; ``model`` gives a struct of ``label, confidence``.
    """
    keyed = papers.withColumn("cache_key", T.content_key(F.lit(provider), F.lit(name), prompt)).withColumn("_prompt", prompt)
    hits = cache.where("label IS NOT NULL").select(F.col("key").alias("cache_key"), "label", "confidence")
    if refresh:
        hits = hits.limit(0)
    asked = keyed.groupBy("cache_key").agg(F.any_value("_prompt").alias("_prompt")).join(hits.select("cache_key"), "cache_key", "left_anti")
    replies = asked.withColumn("_reply", model(F.col("_prompt"))).select("cache_key", "_reply.label", "_reply.confidence", F.lit(False).alias("cached"))
    side = hits.withColumn("cached", F.lit(True)).unionByName(replies)
    return keyed.join(side, "cache_key", "left").withColumn("label", T.label(F.col("label"))).drop("_prompt")
