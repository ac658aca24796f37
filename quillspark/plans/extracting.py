"""Registered queries of data sets that a model's replies tell of, from prompts to sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import extraction, master
from quillspark.plans import flows
from quillspark.plans.catalogue import Tables, query
from quillspark.sources import shared, writers

# What the recorded replies say of a text of n characters: one in ten is no JSON, one is fenced, one has
# entries that do not fit, one has no list.
_SAID = """p AS (SELECT doc_id AS id, lang, length(coalesce(text, '')) AS n, coalesce(lang, '') AS venue, 2000 + doc_id % 20 AS year, concat('Corpus ', coalesce(source, 'none'), ' ', length(coalesce(text, '')) % 40) AS name
  FROM documents WHERE doc_id IS NOT NULL),
 r AS (SELECT *, ['introduced', 'reused', 'unclear'][n % 3 + 1] AS rel, coalesce(nullif(regexp_replace(lower(lang), '[^a-z0-9]', '', 'g'), ''), 'unknown') || year || 'paper' AS key,
   CASE WHEN n % 4 = 0 THEN concat('See https://h.org/', n % 6, ').') ELSE '' END AS notes, CASE n % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE '' END AS open FROM p
   WHERE n % 10 NOT IN (0, 3) AND n % 7 >= CASE WHEN n % 3 = 0 THEN 6 ELSE 5 END)"""


def _papers(t: Tables) -> DataFrame:
    n, none = F.length(T._text("text")), F.lit(None).cast("string")
    at = t.documents.where("doc_id IS NOT NULL")
    return at.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.concat(F.lit("Paper "), (n % 1000).cast("string")).alias("title"), F.when(T._text("lang") != "", F.concat(F.lit("Ann "), "lang")).alias("authors"),
        F.col("lang").alias("venue"), (F.lit(2000) + F.col("doc_id") % 20).alias("year"), none.alias("doi"), F.col("text").alias("abstract"), none.alias("pdf_text"), "source", n.alias("n"),
    )


def _recorded(papers: DataFrame) -> DataFrame:
    n, word = F.col("n"), lambda c: c.cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("introduced", "Reused", "invented"))), (n % 3 + 1).cast("int"))
    fields = {
        "name": F.concat(F.lit(" Corpus "), F.coalesce("source", F.lit("none")), F.lit(" "), word(n % 40)), "relationship_type": kind, "confidence": (n % 7) / 10,
        "modalities": F.array(F.lit(" texts "), F.lit("")), "osi_layers": F.array(F.concat(F.lit("l"), word(n % 9))), "collection_environment": F.when(n % 2 == 0, "Simulation").otherwise("Moon"),
        "availability": F.when(n % 5 == 0, True).when(n % 5 == 1, False), "availability_notes": F.when(n % 4 == 0, F.concat(F.lit("See https://h.org/"), word(n % 6), F.lit(")."))),
    }
    one = F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))
    good = F.concat(F.lit('{"datasets": ['), one, F.lit("]}"))
    mixed = F.concat(F.lit('{"datasets": ["x", {"name": " ", "confidence": "high"}, '), one, F.lit("]}"))
    reply = F.when(n % 10 == 0, "I cannot tell").when(n % 10 == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(n % 10 == 2, mixed).when(n % 10 == 3, '{"datasets": null}').otherwise(good)
    asked = F.coalesce(*(p for _, p in extraction.attempts()))
    return papers.select(extraction.key(asked).alias("key"), reply.alias("reply")).groupBy("key").agg(F.min("reply").alias("reply"))


def _extracted(t: Tables) -> flows.Extracted:
    papers = _papers(t)
    return flows.extract(papers, shared.save(_recorded(papers), "recorded"))


@query(f"""WITH {_SAID}, u AS (SELECT *, count(*) OVER (PARTITION BY venue, year, name) AS used FROM r)
 SELECT name AS "Dataset Name", coalesce(arg_min(key, id) FILTER (WHERE rel = 'introduced'), arg_min(key, id)) AS "Bibtex Citation Key", arg_min(CASE WHEN n % 9 BETWEEN 1 AND 7 THEN 'L' || n % 9 ELSE '' END, id) AS "OSI Layer (L1-L7)",
  'texts' AS "Modality(ies)", arg_min(open, id) AS "Availability (Open? Y/N)", arg_min(CASE WHEN notes <> '' AND open = '' THEN concat('https://h.org/', n % 6) ELSE '' END, id) AS "Availability URL", arg_min(notes, id) AS "Annotations on Availability",
  arg_min(CASE WHEN n % 2 = 0 THEN 'Simulation' ELSE 'Real World Deployment' END, id) AS "Collection Environment", arg_min(used, id) AS "Number of Papers using Dataset" FROM u GROUP BY name""")
def extract_datasets(t):
    """All documents as papers, replies recorded by prompt, read, cleaned and rolled up into the sheet of data sets."""
    return writers.extraction_datasets(_extracted(t).papers)


@query(f"""WITH {_SAID} SELECT doc_id AS id, CASE WHEN trim(coalesce(text, '')) <> '' THEN 'abstract' ELSE 'title_only' END AS extraction_source,
  CASE WHEN length(coalesce(text, '')) % 10 = 0 THEN 'reply is no JSON object' END AS error, coalesce(r.name, '') AS names,
  CAST(CASE WHEN length(coalesce(text, '')) % 10 = 2 THEN 3 ELSE 0 END AS BIGINT) AS rejected FROM documents LEFT JOIN r ON doc_id = r.id WHERE doc_id IS NOT NULL""")
def extraction_attempts(t):
    """Which of a paper's texts was asked about, what came of it, and how much of the reply did not fit."""
    done = _extracted(t)
    lost = done.rejected.groupBy("id").agg(F.count("*").alias("rejected"))
    names = F.array_join(F.transform("datasets", lambda d: d["name"]), "; ")
    return done.papers.join(lost, "id", "left").select("id", "extraction_source", "error", names.alias("names"), F.coalesce("rejected", F.lit(0).cast("bigint")).alias("rejected"))


_NORM = r"regexp_replace(regexp_replace(lower(trim(name)), '[- ]+(dataset|traces|measurements|data|evaluation)s?$', ''), '\s+', ' ', 'g')"


@query(rf"""WITH p AS (SELECT p_brand AS run, p_size AS paper, p_partkey AS ord, CASE WHEN p_brand LIKE '%1' AND p_partkey % 3 = 0 THEN p_name || ' traces' ELSE p_name END AS name,
   CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand || p_partkey END AS key FROM part WHERE p_brand NOT LIKE '%5' AND NOT (p_brand LIKE '%1' AND p_partkey % 2 = 1) AND trim(p_name) <> '')
 SELECT first(name ORDER BY run, ord) AS name, coalesce(first(key ORDER BY run, ord) FILTER (WHERE key <> ''), '') AS key, CAST(sum(paper) AS BIGINT) AS summed, count(DISTINCT (run, paper)) AS papers
 FROM p GROUP BY {_NORM} HAVING count(DISTINCT (run, paper)) >= 2""")
def master_incremental(t):
    """Parts as data sets of brands' runs: all are put in, then some runs are made again and some dropped; the list
    of what two papers or more have."""
    key = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat("p_brand", F.col("p_partkey").cast("string")))
    first = t.part.where("p_brand IS NOT NULL").select(F.col("p_brand").alias("run"), F.col("p_size").alias("paper"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), key.alias("key"), F.col("p_size").cast("string").alias("number"))
    path = shared.new(t.spark, "master")
    master.replace(t.spark, path, first.select("run"), first, first)
    again = first.where("run LIKE '%1' AND ord % 2 = 0").withColumn("name", F.when(F.col("ord") % 3 == 0, F.concat("name", F.lit(" traces"))).otherwise(F.col("name")))
    master.replace(t.spark, path, first.where("run LIKE '%1' OR run LIKE '%5'").select("run"), again, again)
    return master.merged(t.spark, path, 2)
