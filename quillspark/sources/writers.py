"""Sheets, JSON and reports.  Rows are written by Spark; only rolled-up rows reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSIFIED = ("title", "authors", "doi", "venue", "year", "label", "confidence", "used_abstract", "has_abstract")


def sheet(df: DataFrame, path: str, columns: tuple[str, ...] = CLASSIFIED, mode: str = "overwrite") -> None:
    """CSV with a header; lists are joined by ``; ``."""
    kinds = dict(df.dtypes)
    df.select(*(F.array_join(c, "; ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns)).write.mode(mode).csv(path, header=True, escape='"')


def append_evidence(claims: DataFrame, path: str) -> None:
    claims.write.mode("append").partitionBy("run_id").json(path)


def markdown(rollup: DataFrame, title: str) -> str:
    """A table of scores; ``rollup`` has a row for each venue and year, venue, and all."""
    names = ["venue", "year", "tp", "fp", "fn", "jaccard", "precision", "recall", "f1"]
    rows = rollup.orderBy("level", "venue", "year").select("level", *names).collect()
    lines = [f"# {title}"]
    for level, head in ((3, "Overall"), (1, "Per venue"), (0, "Per venue and year")):
        lines += ["", f"## {head}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
        lines += ["| " + " | ".join("all" if r[n] is None else str(r[n]) for n in names) + " |" for r in rows if r["level"] == level]
    return "\n".join(lines) + "\n"


def consolidated(canonical: DataFrame, path: str) -> None:
    """Name, variants (where there are several), papers, reuse, attributes and merge reason."""
    joined = lambda c: F.array_join(c, "; ")
    canonical.select(
        F.col("canonical_name").alias("Canonical Name"), F.when(F.size("all_names") > 1, joined("all_names")).otherwise("").alias("All Name Variants"), joined("keys").alias("Bibtex Citation Keys"),
        F.col("reuse_count").alias("Reuse Count"), F.col("modalities").alias("Modality(ies)"), F.col("osi_layers").alias("OSI Layers"), joined("environments").alias("Collection Environment"),
        F.col("availability_url").alias("Availability URL"), F.col("merge_reason").alias("Merge Reason"),
    ).orderBy(F.desc("Reuse Count"), F.lower("Canonical Name")).write.mode("overwrite").csv(path, header=True, escape='"')


def nested_runs(papers: DataFrame, path: str) -> None:
    """One JSON object for each venue and year with its papers."""
    papers.groupBy("venue", "year").agg(F.count("*").alias("total_papers"), F.sort_array(F.collect_list(F.struct("ord", *(c for c in papers.columns if c not in ("venue", "year", "ord"))))).alias("papers")).write.mode("overwrite").json(path)


def extraction_papers(papers: DataFrame) -> DataFrame:
    """The sheet of papers; ``datasets`` has structs with ``name``."""
    names = F.array_join(F.transform("datasets", lambda d: d["name"]), "; ")
    return papers.select(
        F.col("title").alias("Paper Title"), F.col("authors").alias("Authors"), F.col("venue").alias("Conference"), F.col("year").alias("Year"),
        names.alias("Datasets"), F.col("bibtex_key").alias("Bibtex Citation Key"),
    )


def extraction_bibtex(papers: DataFrame) -> DataFrame:
    """The sheet of citations."""
    doi = F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("doi:"), "doi")).otherwise("")
    return papers.select(F.col("bibtex_key").alias("Bibtex Citation Key"), doi.alias("DOI Version of Key"), F.col("bibtex").alias("Bibtex Citation"))


def extraction_datasets(papers: DataFrame) -> DataFrame:
    """The sheet of data sets: for each name the first record, the paper that introduced it (else the
    first), and how many papers have it, by name.  ``ord`` is the papers' order."""
    each = papers.select("ord", "bibtex_key", F.posexplode("datasets").alias("place", "d")).withColumn("at", F.struct("ord", "place"))
    first = F.min_by(F.struct("d.*"), "at").alias("d")
    introducing = F.min_by("bibtex_key", F.when((F.col("d.relationship_type") == "introduced") & (F.coalesce("bibtex_key", F.lit("")) != ""), F.col("at")))
    one = each.groupBy(F.col("d.name").alias("name")).agg(first, F.count("*").alias("papers"), F.min_by("bibtex_key", "at").alias("first_key"), introducing.alias("own_key"))
    joined = lambda c: F.array_join(F.col(c), "; ")
    return one.select(
        F.col("name").alias("Dataset Name"), F.coalesce("own_key", "first_key", F.lit("")).alias("Bibtex Citation Key"), joined("d.osi_layers").alias("OSI Layer (L1-L7)"), joined("d.modalities").alias("Modality(ies)"),
        F.when(F.col("d.availability"), "Y").when(~F.col("d.availability"), "N").otherwise("").alias("Availability (Open? Y/N)"), F.coalesce("d.availability_url", F.lit("")).alias("Availability URL"),
        F.coalesce("d.availability_notes", F.lit("")).alias("Annotations on Availability"), F.coalesce("d.collection_environment", F.lit("")).alias("Collection Environment"),
        F.coalesce(F.nullif("d.usage_count", F.lit(0)), "papers").alias("Number of Papers using Dataset"),
    ).orderBy("Dataset Name")


def extraction(papers: DataFrame, folder: str, slug: str) -> None:
    """All sheets of an extraction and its papers as JSON, as folders named after ``slug``."""
    for name, part in (("papers", extraction_papers(papers)), ("bibtex", extraction_bibtex(papers)), ("datasets", extraction_datasets(papers))):
        part.write.mode("overwrite").csv(f"{folder}/{slug}_{name}.csv", header=True, escape='"')
    nested_runs(papers, f"{folder}/{slug}_raw.json")


def match_report(matches: DataFrame, total: int) -> DataFrame:
    """A row for each match, surest first, equal ones in their order; both ends with name and keys."""
    end = lambda s: F.struct(F.col(f"name_{s}").alias("name"), F.col(f"keys_{s}").alias("keys")).alias(s)
    return matches.orderBy(F.desc("confidence"), "ord").select(F.lit(total).cast("bigint").alias("total_records"), "method", "confidence", "reason", end("a"), end("b"))
