import html
import re

from quillspark.llm import html_text as H


def reference_text(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: reference_text(r.html) for r in pages.collect()}
    got = H.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_markup_that_is_no_article():
    page = """<!doctype html><head><title>no</title></head><body class="has-sidebar"><header>Top</header><div id=cookieNotice>c</div>
    <main><article class="post"><header><h1>T &amp; x&nbsp;y</h1></header><p>a<b>b</b> c<br>d<script>"</p>"</script><div class="share-box">s</div>
    <p>e<ul><li>1<li>2</ul><form>f<input></form><aside>z</aside><table><tr><td>q<td>r</table><section class="comments"><article class="comment">hi</article></section>
    <pre>x  y</pre><!-- <p>gone</p> --><p hidden>h</p><p>A &lt; B</p></article></main><footer>f</footer>"""
    assert H.Page(page).text() == "T & x y\nab c d\ne\n1\n2\nq\nr\nx y\nA < B"


def test_pages_without_an_article_lose_what_the_site_repeats(spark):
    unit = lambda k: f"<div><ul><li>Home<li>About</ul></div><div><h1>Title {k}</h1><p>Own text {k}</p><p>By us</p></div><div><p>All rights kept</p></div>"
    rows = [(k, "http://User@Site.org:80/x", unit(k)) for k in range(6)] + [(9, "http://other.org/", unit(9)), (10, None, None), (None, "http://site.org", "")]
    rows += [(20 + k, "http://copies.org/", "<div><p>Same article</p></div>") for k in range(9)]  # copies of one text are no template
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Title 3\nOwn text 3"
    assert got[9] == "Home\nAbout\nTitle 9\nOwn text 9\nBy us\nAll rights kept"
    assert got[10] == "" and got[None] == "" and got[24] == "Same article"


def test_template_inside_an_article_but_no_prose(spark):
    page = lambda k: f"<article><p>Text {k}</p><p>Common passage</p><div>Follow us everywhere</div></article>"
    rows = [(k, "https://a.org/", page(k), "x", 1) for k in range(7)]
    got = H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, host int"))
    assert {r.page_id: r.text for r in got.collect()}[2] == "Text 2\nCommon passage"


def test_broken_markup_ends():
    for page in ("<p", "<div <p>a", "<p title='x>y", "<!-- x", "<script>x", "a<b", "</p></div>x", "<p>" * 3000 + "x", "<div>" * 3000 + "y", "<![CDATA[z]]>w", "&#xD800;&bogus;&amp"):
        assert isinstance(H.Page(page).text(), str)
    assert H.Page("<p>a<!-- x").text() == "a"
    assert H.Page("<p>a" + '<b "' * 50_000).text().startswith("a")


def test_empty_table_and_repeats(spark):
    kind = "page_id bigint, url string, html string"
    assert H.extract(spark.createDataFrame([], kind)).collect() == []
    assert [r.text for r in H.extract(spark.createDataFrame([(1, "http://a.org", "<p>x</p>")] * 2, kind)).collect()] == ["x", "x"]


def test_counts_alone_tell_template_that_bears_no_mark(spark):
    """Switching markup off leaves the same texts where a site repeats itself; switching counts off does not."""
    page = lambda k: f'<body><div class="q7"><p>Alpha {k % 2} beta</p></div><div class="z1"><p>Own {k}</p><p>Shared passage</p><p>More {k}</p></div><div class="k3">Mail {"us" if k else "me"}</div></body>'
    rows = spark.createDataFrame([(k, "https://a.org/", page(k)) for k in range(40)] + [(99, "https://few.org/", page(1))], "page_id bigint, url string, html string")
    want = {k: f"Own {k}\nShared passage\nMore {k}" for k in range(40)}
    for markup in (True, False):
        got = {r.page_id: r.text for r in H.extract(rows, markup=markup).collect()}
        assert got.pop(99) == "Alpha 1 beta\nOwn 1\nShared passage\nMore 1\nMail us" and got == want
    off = {r.page_id: r.text for r in H.extract(rows, min_pages=1000).collect()}
    assert off[3] == "Alpha 1 beta\nOwn 3\nShared passage\nMore 3\nMail us"


def test_template_against_counting(spark):
    import collections
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(5), rng.randrange(12) ** 2 // 12, rng.randrange(30)) for _ in range(700)]
    n = collections.Counter((h, p, x) for h, p, x, _ in set(rows))
    total, often = collections.Counter(), collections.Counter()
    for (h, p, _), c in n.items():
        total[h, p] += c
        often[h, p] += c if c >= 4 else 0
    share = {k: often[k] / total[k] for k in total}
    want = {(h, p, None) for h, p in share if share[h, p] >= 0.9} | {(h, p, x) for (h, p, x), c in n.items() if c >= 4 and 0.5 <= share[h, p] < 0.9}
    got = H.template(spark.createDataFrame(rows, "host bigint, place bigint, hash bigint, main bigint"), 4).collect()
    assert {(r.host, r.place, r.hash) for r in got} == want and len(want) > 5


def test_deep_markup_takes_seconds():
    import time

    began = time.perf_counter()
    assert H.Page("<div>" * 20_000 + "x" + "</b></p>" * 20_000).text() == "x"
    assert H.Page("<div><main>" * 10_000 + "y").text() == "y"
    assert time.perf_counter() - began < 5
