import random

from quillspark.operators import resolve
from test_similarity_pairs import brute, signed


def test_first_pair_among_records_of_few_texts(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["alpha beta", "alpha beto", "zeta omega", "data", "dataset"]), [rng.choice("xy") if k % 40 else "z"], rng.choice(["LONG MODALITY", "SHORT"]), f"L{k % 2}") for k in range(90)]
    df = spark.createDataFrame(rows, "ord bigint, name string, keys array<string>, modalities string, osi_layers string").repartition(3)
    none = spark.createDataFrame([], "name_a string, name_b string")
    found = resolve.first_similar(df, none)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert sorted(tuple(r)[:4] for r in found.collect()) == brute(signed(rows), [])
