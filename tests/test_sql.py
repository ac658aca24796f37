"""Functions and the table function by name in SQL, and the edges that stand for all pairs of a link."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import html, similarity, unicode
from quillspark.operators import resolve
from quillspark.plans import sql
from quillspark.sources import program_pages

PAGE = """<h2>Papers Info</h2><p>09:00 — 10:20 | Nets</p><p>Title one</p><p>A B (X)</p><p><a href="/doi/10.1145/1"></a></p><p>Abstract: One &amp; all.</p>
<p>Café ²</p><p>C D (Y); E (Z)</p><p>Abstract: Two.</p>"""


@pytest.fixture(scope="module")
def pages(spark):
    sql.register(spark)
    rows = [(1, "https://dl.acm.org/p", PAGE), (2, None, PAGE), (3, "", "<p>no papers</p>"), (4, None, None), (5, "x", ""), (1, "https://dl.acm.org/p", PAGE)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, title string")
    df.createOrReplaceTempView("program_pages_here")
    return df


def test_sql_equals_frames(spark, pages):
    got = spark.sql("SELECT p.page_id, s.* FROM program_pages_here p, LATERAL program_papers(p.html, p.url) s")
    want = program_pages.read(pages)
    assert got.columns == want.columns
    key = lambda r: repr(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and want.count() == 6
    assert {r["doi"] for r in got.where("ord = 0").collect()} == {"10.1145/1", None}


def test_functions_in_sql(spark, pages):
    got = spark.sql("SELECT nfkd(html) AS n, ratio(html, title) AS r, html_clean(html, url) AS c, nfkd(CAST(NULL AS STRING)) AS none FROM program_pages_here")
    want = pages.select(unicode.nfkd("html").alias("n"), similarity.ratio("html", "title").alias("r"), html.clean("html", "url").alias("c"), F.lit(None).cast("string").alias("none"))
    key = lambda r: repr(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert unicodedata.normalize("NFKD", PAGE) in {r["n"] for r in got.collect()}


def test_chosen_columns(spark, pages):
    one = spark.sql("SELECT s.* FROM program_pages_here p, LATERAL program_papers(p.html, fields => 'doi, title', base => p.url) s")
    assert one.columns == ["doi", "title"] and one.dtypes == [("doi", "string"), ("title", "string")]
    assert ("10.1145/1", "Title one") in {tuple(r) for r in one.collect()}
    for wrong in ("program_papers(p.html, p.url, 'title, nothing')", "program_papers(p.html, p.url, p.title)", "program_papers(p.page_id, p.url)"):
        with pytest.raises(Exception, match="program_papers"):
            spark.sql(f"SELECT s.* FROM program_pages_here p, LATERAL {wrong} s").collect()


def test_no_pages(spark, pages):
    pages.limit(0).createOrReplaceTempView("no_program_pages")
    assert spark.sql("SELECT s.* FROM no_program_pages p, LATERAL program_papers(p.html, p.url) s").count() == 0


def test_star_joins_what_pairs_join(spark):
    rng = random.Random(7)
    schema = "ord int, name string, keys array<string>, availability_url string, availability_notes string, doi string"
    for _ in range(3):
        rows = [
            (k, rng.choice([f"n{rng.randrange(40)}", None, ""]) if rng.random() < 0.1 else f"n{rng.randrange(40)}", rng.choice([["a"], ["b"], ["b", "a"], [], None]),
             f"https://x.org/{rng.randrange(25)}" if rng.random() < 0.6 else None, "", f"10.1/{rng.randrange(25)}" if rng.random() < 0.2 else "")
            for k in range(80)
        ]
        df = spark.createDataFrame(rows, schema)
        ends = lambda pairs: pairs.where("name_a IS NOT NULL AND name_b IS NOT NULL").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
        want, got = (sorted(map(tuple, resolve.components(ends(p)).collect())) for p in (resolve.url_pairs(df), resolve.url_star(df)))
        alone = {n for n, root in want if root == n} - {root for n, root in want if root != n}
        assert got == [r for r in want if r[0] not in alone] and len(got) > 5
    assert resolve.url_star(df.limit(0)).count() == 0
