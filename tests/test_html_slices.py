import tracemalloc

import pyarrow as pa

from quillspark.functions import html


def test_links_of_few_pages_are_held_at_once():
    page = "<p>text</p>" + "".join(f"<a href='/{k}'>word {k}</a>" for k in range(40))
    pages, bases = pa.array([page, None] * 800), pa.array(["https://h.org/"] * 1600)
    tracemalloc.start()
    out = html.clean.func(pages, bases)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1600 and out[0].as_py() == html.read(page, "https://h.org/") and out[1].as_py() == {"text": "", "links": []}
    assert most < 4_000_000
