import datetime
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import asof as A, catalogue

ORDER = "client bigint, at bigint, order_id bigint, priority bigint, value bigint"


def brute(events, orders, tolerance):
    first = {}
    for i, c, t in events:
        if i is not None:
            key = (t is None, t or 0, c is None, c or 0)
            if i not in first or key < first[i][0]:
                first[i] = key, (c, t)
    out = []
    for i, (_, (c, t)) in first.items():
        mine = [] if c is None or t is None else [o for o in orders if o[0] == c and o[1] is not None and o[1] <= t and t - o[1] <= tolerance]
        if not mine:
            out.append((i, c, t, None, None, None, 0))
            continue
        at = max(o[1] for o in mine)
        tied = [o for o in mine if o[1] == at]
        best = min(tied, key=lambda o: (o[3] is None, o[3] or 0, o[2] is None, -(o[2] or 0), o[4] is None, o[4] or 0))
        out.append((i, c, t, best[2], t - at, best[4], len(tied)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(5)
    pick = lambda: rng.choice([None, *range(6), *[7] * 9])
    events = [(n, pick(), rng.choice([None, *(rng.randrange(-900, 3000) for _ in range(20))])) for n in range(800)]
    events += events[:60] + [(None, 7, 5), (3, 7, 1), (2000, 7, 1500)] + [(3000 + n, 7, 1000) for n in range(200)]
    orders = [(pick(), rng.choice([None, *(rng.randrange(-900, 3000) for _ in range(20))]), rng.choice([None, n]), rng.choice([None, 1, 2]), rng.choice([None, n])) for n in range(500)]
    return events, orders + orders[:40]


@pytest.mark.parametrize("shard, heavy, finest, tolerance", [(50_000, 4096, 10, 100), (20, 16, 3, 100), (5, 8, 0, 7), (10, 4, 2, 1), (3, 2, 5, 100_000)])
def test_join_against_brute_force(spark, as_rows, shard, heavy, finest, tolerance):
    events, orders = cases()
    left = spark.createDataFrame(events, "id bigint, client bigint, at bigint").withColumns({"shard": F.lit(1), "chunk": F.lit(2)}).repartition(3)
    right = spark.createDataFrame(orders, ORDER).withColumns({"halvings": F.lit(1), "n_tied": F.lit(9)}).repartition(2)
    assert as_rows(A.join(left, right, tolerance, shard, heavy, finest)) == brute(events, orders, tolerance)


def test_empty_sides(spark, as_rows):
    events, orders = cases()
    left, right = spark.createDataFrame(events, "id bigint, client bigint, at bigint"), spark.createDataFrame(orders, ORDER)
    assert as_rows(A.join(left, right.limit(0), 10)) == brute(events, [], 10)
    assert as_rows(A.join(left.limit(0), right, 10)) == []
    assert as_rows(A.join(left.limit(0), right.limit(0), 10)) == []


def test_a_hot_client_is_cut_and_others_are_not():
    assert A.cuts(1e-5, 1000, 12) == (0, 1)
    assert A.cuts(1 / 3, 1000, 12) == (5, 1)
    halvings, ways = A.cuts(1 / 3, 10**8, 12)
    assert halvings == A.FINEST and 12 * 2**halvings * ways >= 10**8 / 3


def test_times_do_not_depend_on_the_zone(spark):
    times = [datetime.datetime(2024, 3, 31, 2, 30, 0, 7), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), datetime.datetime(2024, 2, 29, 23, 0, 1), None]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    want = [None if t is None else int((t - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1)) for t in times]
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r.n for r in df.select(A.micros(df, "t").alias("n")).collect()] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert spark.range(1).select(A.floored(F.lit(-1), 10).alias("n")).first().n == -10


def test_query_against_brute_force_on_part_of_a_table(spark, sf, as_rows):
    clicks, sales = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("clicks", "sales"))
    epoch = datetime.datetime(1970, 1, 1)

    def at(t, key):
        if t is None:
            return None
        n = int((t - epoch) / datetime.timedelta(microseconds=1))
        return n - n % A.HOUR if zlib.crc32(str(key).encode()) % 2 else n

    def cents(x):
        return None if x is None else int((100 * x + 0.5) // 1)

    events = [(r.click_id, r.client_id, at(r.ts, r.click_id)) for r in clicks.collect()]
    orders = []
    for r in sales.collect():
        orders.append((r.client_id, at(r.sold_at, r.sale_id), r.sale_id, r.priority, cents(r.total)))
        if zlib.crc32(str(r.sale_id).encode()) % 3:
            orders.append((r.client_id, orders[-1][1], -1 - r.sale_id, None if r.priority is None else 6 - r.priority, cents(r.total)))
    got = as_rows(catalogue.queries()["op11_asof_join"](spark, sf))
    assert got == brute(events, orders, 240 * A.HOUR)
