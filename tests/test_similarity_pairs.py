import re
from difflib import SequenceMatcher

from quillspark.operators import resolve
from quillspark.plans import catalogue


def brute(rows, known):
    """rows: (ord, name, keys, short, whole); the first pair of each pair of names, all records compared."""
    out, seen = [], set(known)
    for i, (o, name, keys, short, whole) in enumerate(rows):
        for p, other, others, s, w in rows[i + 1 :]:
            ends = tuple(sorted((name, other)))
            if ends in seen or set(keys) == set(others):
                continue
            a, b = SequenceMatcher(None, short, s).ratio(), SequenceMatcher(None, whole, w).ratio()
            if a >= 0.75 or b >= 0.70:
                seen.add(ends)
                out.append((o, p, name, other))
    return sorted(out)


def signed(records):
    norm = lambda s: re.sub(r"\s+", " ", s).strip()
    out = []
    for o, name, keys, modalities, layers in records:
        short = norm(re.sub(r"\b(dataset|traces|measurements|data|performance)\b", "", re.sub("[^a-z0-9 ]", " ", name.lower())))
        out.append((o, name, keys, short, f"{short} {norm(re.sub('[^a-z0-9 ,]', ' ', modalities.lower()))} {layers.lower()}"))
    return sorted(out)


def test_query_compares_all_records(spark, tmp_path):
    parts = [(k, ("alpha beta", "gamma delta", "zeta omega")[k % 3], f"Brand#{k % 4}", "LONG SHARED MODALITY TEXT" if k > 5 else f"{'xyzwvq'[k] * 25}", k % 5) for k in range(12)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r)[:4] for r in catalogue.queries()["similarity_pairs"](spark, str(tmp_path)).collect())
    records = signed((k, n, [b], m, f"L{s % 7 + 1}") for k, n, b, m, s in parts)
    known = {(n, n) for _, n, *_ in parts}  # a link holds a name's first six characters
    want = brute(records, known)
    assert got == want and len({(a, b) for *_, a, b in want}) == 3


def test_first_similar_is_the_whole_join(spark, sf):
    few = catalogue._linked(catalogue.Tables(spark, sf)).where("ord <= 120")
    known = resolve.url_pairs(few)
    want = resolve.without_known(resolve.similar_pairs(few), known)
    assert sorted(map(tuple, resolve.first_similar(few, known).collect())) == sorted(tuple(r) for r in want.select("ord_a", "ord_b", "name_a", "name_b", "confidence", "reason", "method").collect())
