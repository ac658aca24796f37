"""Names that SQL texts can use for what Spark has no function for, and a query that uses them all.

``register(spark)`` makes ``ratio``, ``html_clean`` and ``nfkd`` functions and ``program_papers`` a table function
of a session.  ``nfkd`` is an Arrow function here, as SQL cannot name a Column expression; it equals
``functions.unicode.nfkd``, which DataFrames should use.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import html, similarity
from quillspark.plans.catalogue import query
from quillspark.sources import program_pages


@F.arrow_udf(StringType())
def _nfkd(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFKD", v) for v in x.to_pylist()], pa.string())


def register(spark: SparkSession) -> None:
    """Registers all four; doing it again changes nothing."""
    spark.udf.register("ratio", similarity.ratio)
    spark.udf.register("html_clean", html.clean)
    spark.udf.register("nfkd", _nfkd)
    spark.udtf.register("program_papers", F.udtf(program_pages.ProgramPapers))


_SPACES = r"[\x00-\x20\x7f-\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def programs(documents: DataFrame) -> DataFrame:
    """``doc_id, html``: a program page for each document, with one paper whose abstract is the whole text."""
    told = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _SPACES, " "))
    escaped = F.replace(F.replace(told, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    n = F.col("doc_id").cast("string")
    page = F.concat(
        F.lit('<p><a href="https://dl.acm.org/doi/10.1145/'), n, F.lit('">read</a><script>var x;</script></p><h2>Accepted Papers</h2><h3>09:00 — 10:00 | '), F.coalesce("source", F.lit("none")),
        F.lit("</h3><p>\ufb01gure "), n, F.lit("</p><p>Ann (Lab)</p><p>Abstract: "), escaped, F.lit("</p>"),
    )
    return documents.where("doc_id IS NOT NULL").select("doc_id", page.alias("html"))


@query(rf"""SELECT doc_id, 0 AS ord, 'figure ' || doc_id AS title, 2.0 * (5 + length(CAST(doc_id AS VARCHAR))) / (13 + 2 * length(CAST(doc_id AS VARCHAR))) AS likeness,
 trim(coalesce(source, 'none')) AS session, '10.1145/' || doc_id AS doi, md5(nullif(trim(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')), '')) AS abstract_md5, CAST(1 AS BIGINT) AS links FROM documents WHERE doc_id IS NOT NULL""")
def program_papers(t):
    """Papers of a program page for each document, by SQL alone: lateral join with the table function."""
    register(t.spark)
    return t.spark.sql(
        """SELECT p.doc_id, s.ord, nfkd(s.title) AS title, ratio(s.title, concat('figure ', p.doc_id)) AS likeness, s.session, s.doi, md5(s.abstract) AS abstract_md5,
           CAST(size(html_clean(p.html, 'https://h.org/').links) AS BIGINT) AS links
           FROM {programs} p, LATERAL program_papers(p.html, 'https://h.org/', fields => 'ord, title, session, doi, abstract') s""",
        programs=programs(t.documents),
    )
