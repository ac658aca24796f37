import random
import unicodedata

from quillspark.functions import text as T
from quillspark.functions import unicode as U


def points():
    return [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) not in ("Cn", "Co")]


def test_every_assigned_code_point(spark):
    df = spark.createDataFrame([(p, chr(p)) for p in points()], "p int, c string").repartition(4)
    got = df.select("p", U.nfkd("c").alias("d"), U.unmarked("c").alias("u")).toPandas()
    plain = lambda s: "".join(c for c in s if not unicodedata.combining(c))
    want = [unicodedata.normalize("NFKD", chr(p)) for p in got["p"]]
    assert [p for p, d, w in zip(got["p"], got["d"], want) if d != w] == []
    assert [p for p, u, w in zip(got["p"], got["u"], want) if u != plain(w)] == []


def test_texts_with_marks_in_any_order(spark):
    draw = random.Random(7)
    pool = [0x41, 0x20, 0xE9, 0x1EC7, 0xAC01, 0xFB01, 0x300, 0x316, 0x345, 0x5B0, 0x323, 0x1D15E, 0x20D2, 0x93E, 0x3099, 0x2F801, 0x1D4D0]
    texts = ["", None, "plain", "a\nb"] + ["".join(chr(draw.choice(pool)) for _ in range(draw.randrange(1, 12))) for _ in range(500)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = {r.n: r.d for r in df.select("n", U.nfkd("t").alias("d")).collect()}
    assert [t for n, t in enumerate(texts) if got[n] != (t if t is None else unicodedata.normalize("NFKD", t))] == []


def test_titles_fold_what_decomposes_into_several(spark):
    told = ["Ｗｉ-ﬁ ½ Ⅳ", "Crème", "Tiệ́ng", "ß", None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(told)], "n int, t string")
    want = ["".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)) for t in told]
    assert [r[0] for r in df.orderBy("n").select(T.fold_accents("t")).collect()] == want
