import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import html, text as T
from quillspark.functions.similarity import ratio


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or ("",)], [*values] or ["x"])
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.normalize_title, "  Déjà-Vu:  RF Sensing! ", "deja vu rf sensing"),
        (T.normalize_title, "", ""),
        (T.normalize_doi, "https://doi.org/10.1145/ABC.123", "10.1145/abc.123"),
        (T.normalize_doi, "doi:10.1/X/", "10.1/x"),
        (T.merge_name, " 5G Traces - Dataset", "5g traces"),
        (T.record_name, "5G Network Throughput Dataset", "5g network throughput"),
        (T.normalize_url, "https://github.com/a/B.git", "github.com/a/b"),
        (T.normalize_url, "https://github.com/a/b/tree/main/x", "github.com/a/b"),
        (T.normalize_url, "http://h.org:80/p/?q=1#f", "h.org:80/p"),
        (T.doi_in, "see 10.1145/3651890.3672226 there", "10.1145/3651890.3672226"),
        (T.score_title, "A: b-c  d!", "a bc d"),
        (T.null_words, "NaN", ""),
        (T.verdict, 'ok ```{"match": "YES"}```', "yes"),
        (T.verdict, "prose", "unsure"),
        (T.label, "??", "maybe"),
        (T.arxiv_pdf, "http://arxiv.org/abs/1", "http://arxiv.org/pdf/1"),
        (T.arxiv_query, "A b: c", "all:A AND all:b AND all:c"),
        (T.first_heading, "<h1 class=x>A <b>b</b></h1>", "A b"),
        (T.salvage_json, '```json\n{"a": 1}\n```', '{"a": 1}'),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f("v"), v=value) == want


def test_years(spark):
    assert one(spark, T.year_number("v"), v="2024.0") == 2024
    assert one(spark, F.coalesce(T.year_number("v"), F.lit(-1)), v="soon") == -1


def test_urls_and_authors(spark):
    assert one(spark, T.urls(F.col("v")), v="a https://x.org/1, (http://y.org/2)") == ["https://x.org/1", "http://y.org/2"]
    assert one(spark, T.authors("v"), v="Ryu Okubo 0001, B C and D") == ["Ryu Okubo", "B C", "D"]


def test_inverted_index(spark):
    index = F.create_map(F.lit("Wireless"), F.array(F.lit(0)), F.lit("sensing"), F.array(F.lit(1), F.lit(3)), F.lit("and"), F.array(F.lit(2)))
    assert one(spark, T.inverted_to_text(index)) == "Wireless sensing and sensing"


def test_citations(spark):
    key = T.bibtex_key(F.col("a"), F.lit(2024), F.col("t"))
    assert one(spark, key, a="Ada Lovelace, G Hopper", t="On the Engine") == "lovelace2024on"
    assert one(spark, key, a="", t=" ") == "unknown2024paper"
    entry = T.minimal_bibtex(F.lit("k"), F.col("t"), F.col("a"), F.lit(2024), F.lit("IMC"), F.lit(""))
    assert one(spark, entry, t="T", a="A;B") == "@inproceedings{k,\n  title     = {T},\n  author    = {A and B},\n  booktitle = {IMC},\n  year      = {2024},\n}"
    assert one(spark, T.rekey_bibtex(F.col("e"), F.lit("new")), e="@article{old,\n title={x}}") == "@article{new,\n title={x}}"
    assert one(spark, T.bibtex_field(F.col("e"), "abstract"), e="@a{k, title={T}, abstract = {last one}}") == "last one"


def test_content_key(spark):
    assert one(spark, T.content_key(F.lit("p"), F.lit("m"), F.col("v")), v="x") == "v1:" + hashlib.sha256(b"p\0m\0x").hexdigest()


def test_ratio_is_the_asymmetric_one(spark):
    from difflib import SequenceMatcher

    a, b = "5g network throughput", "throughput of 5g networks"
    df = spark.createDataFrame([(a, b), (b, a), (None, a)], "a string, b string")
    got = [r[0] for r in df.select(ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio(), None]


def test_html(spark):
    page = '<p>One<script>no</script> two</p><div><a href="/x">Link  text</a><a href="y"></a></div>'
    got = one(spark, html.clean(F.col("p"), F.lit("https://h.org/d/")), p=page)
    assert got["text"] == "One two\nLink text [https://h.org/x] [https://h.org/d/y]"
    assert [tuple(x) for x in got["links"]] == [("Link text", "https://h.org/x"), ("", "https://h.org/d/y")]
