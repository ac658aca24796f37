import json
import os
import sys
from urllib.parse import unquote

from pyspark import cloudpickle

from quillspark.operators import waterfall as W

LONG = "An abstract that is surely longer than forty characters"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not see the tests
KIND = "id int, title string, doi string, url string"


def words(text):
    out = {}
    for k, w in enumerate(text.split()):
        out.setdefault(w, []).append(k)
    return out


def answer(url):
    """A fake of all providers; what each knows goes by the DOI or title in the address."""
    at = unquote(url)
    if "usenix.org" in at:
        return f"<h1>Usenix paper</h1><div class='field field-name-field-paper-description x'><p>{LONG} usenix</p> NSDI '24 <b>BibTeX</b> more</div>" if at.endswith("good") else "<h1>Something else entirely</h1>"
    if "openalex" in at:
        if "10.1/oa" in at:
            return json.dumps({"abstract_inverted_index": words(LONG + " openalex")})
        if "search=Open title" in at:
            return json.dumps({"results": [{"title": "Open Title", "abstract_inverted_index": words(LONG + " found")}]})
        return json.dumps({"results": [{"title": "Another one", "abstract_inverted_index": words("wrong")}]})
    if "crossref" in at:
        return json.dumps({"message": {"abstract": f"<jats:p>{LONG} crossref</jats:p>" if "10.1/cr" in at else "<p>short</p>"}})
    if "semanticscholar" in at:
        if "DOI:10.1/s2" in at:
            return json.dumps({"abstract": LONG + " s2"})
        return json.dumps({"data": [{"title": "Scholar title", "abstract": LONG + " s2 search"}]}) if "query=Scholar title" in at else "no json"
    if "arxiv" in at:
        return f"<feed><entry><title>Preprint\n title</title><summary> {LONG}\n arxiv </summary></entry></feed>"
    if "acm" in at:
        return f"<section id='abstract'><p>{LONG} acm</p></section>" if "10.1/acm" in at else f"<meta name='description' content='{LONG} meta'>"
    raise AssertionError(url)


ROWS = [
    (1, "Usenix paper", None, "https://www.usenix.org/good"), (2, "Usenix paper", "10.1/oa", "https://www.usenix.org/bad"), (3, "x", "10.1/oa", ""), (4, "Open title", "", None), (5, "x", "10.1/cr", None),
    (6, "x", "10.1/s2", None), (7, "Scholar title", None, None), (8, "Preprint title", None, None), (9, "x", "10.1/acm", None), (10, "x", "10.1/none", None), (11, None, None, None), (12, "  ", " ", ""), (13, "Open title", "", None),
]
WANT = {1: ("usenix", "usenix"), 2: ("openalex", "openalex"), 3: ("openalex", "openalex"), 4: ("openalex", "found"), 5: ("crossref", "crossref"), 6: ("semantic_scholar", "s2"), 7: ("semantic_scholar", "s2 search"), 8: ("arxiv", "arxiv"), 9: ("acm", "acm"), 10: ("acm", "meta"), 11: ("miss", None), 12: ("miss", None), 13: ("openalex", "found")}


def told(df):
    return {r.id: (r.provider, r.value and r.value.removeprefix(LONG).strip()) for r in df.collect()}


def test_each_provider_is_asked_for_what_is_missing_and_a_restart_for_nothing(spark, tmp_path):
    log, folder = tmp_path / "log", f"file://{tmp_path}/run"
    log.mkdir()

    def fetch(url):
        with open(log / str(os.getpid()), "a") as f:
            f.write(url + "\n")
        return answer(url)

    asked = lambda: [line for f in log.iterdir() for line in f.read_text().splitlines()]
    rows = spark.createDataFrame(ROWS, KIND)
    steps = W.abstract_steps(acm=True)
    assert told(W.run(rows, steps[:4], fetch, folder=folder)).items() >= {k: WANT[k] for k in (1, 2, 3, 4, 5)}.items()
    before = asked()
    assert len(before) == len(set(before))  # rows that share a request share its answer
    assert not any("10.1/oa" in unquote(u) for u in before if "crossref" in u)
    found = W.run(rows, steps, fetch, folder=folder)
    assert told(found) == WANT and len(asked()) == len(set(asked()))
    assert told(W.run(rows, steps, fetch, folder=folder)) == WANT and len(asked()) == len(set(asked()))
    # misses and finds go into the cache, and nobody is asked again
    cache = W.entries(rows, found)
    count = len(asked())
    again = told(W.run(rows.where("id NOT IN (11, 12)"), steps, fetch, cache=cache))
    assert again == {k: v for k, v in WANT.items() if k not in (11, 12)} and len(asked()) == count


def test_recorded_answers(spark):
    rows = spark.createDataFrame(ROWS, KIND)
    steps = W.abstract_steps(acm=True)
    requests = {r[0] for s in steps for r in rows.select(s.request).collect() if r[0]}
    recorded = spark.createDataFrame([(u, answer(u)) for u in requests], "request string, payload string")
    assert told(W.run(rows, steps, recorded)) == WANT
    assert W.run(rows.limit(0), steps, recorded).collect() == []


class Busy(Exception):
    def __init__(self, code, after=None):
        self.code, self.headers = code, {"Retry-After": after} if after else None


def test_budget_and_retry_after(spark):
    assert [W.wait(Busy(429, "7"), 3), W.wait(Busy(429, "900"), 0), W.wait(Busy(503), 2), W.wait(Busy(429, "soon"), 9), W.wait(OSError(), 0)] == [7.0, 30.0, 6.0, 20.0, 1.5]
    assert W.passing(Busy(503)) and not W.passing(Busy(404)) and W.passing(ConnectionError()) and not W.passing(ValueError())

    def clocked():
        now, slept, tried = [0.0], [], {}

        def sleep(n):
            slept.append(n)
            now[0] += n

        def fetch(url):
            tried[url] = tried.get(url, 0) + 1
            if url.endswith("busy") and tried[url] < 3:
                raise Busy(429, "5")
            if url.endswith("gone"):
                raise Busy(404)
            return json.dumps(slept)

        return W.Budget({"a": 2.0}, lanes=1, tries=3, sleep=sleep, clock=lambda: now[0]), fetch

    budget, fetch = clocked()
    rows = spark.createDataFrame([(f"http://a/{n}",) for n in (1, 2, 3)] + [("http://b/busy",), ("http://a/gone",)], "request string").coalesce(1)
    got = {r.request: r.payload for r in W.asked(rows, fetch, budget).collect()}
    assert got["http://a/gone"] is None and 5.0 in json.loads(got["http://b/busy"])
    last = max((json.loads(got[f"http://a/{n}"]) for n in (1, 2, 3)), key=len)
    assert sum(x for x in last if x <= 0.5) >= 0.99  # two waits of half a second between three requests
