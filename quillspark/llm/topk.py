"""Exact top-k inner products with a pivot-distance index.

Components become integers ``floor(SCALE * x)``, so scores are exact.  A vector gains a coordinate
that brings all to one length; then the largest inner products with a query are its nearest
vectors.  Every vector is keyed by its nearest pivot and its distance to it.  Along each pivot
the distances are sorted and cut into blocks (annuli) of bounded size.

Search expands annuli step by step.  A step takes, along every pivot, the blocks whose distances come
nearer to the query's own than the step's radius; after each step the k-th score so far bounds the
distances that can still matter, and by the triangle inequality only blocks within that bound are
left.  It stops when no query has a block left.  Inside a block the sorted distances narrow the rows
once more.  Blocks meet queries in parts of bounded size.

Pivots come from a bounded sample: the ``SAMPLE`` vectors whose ids hash lowest.  All vectors are
indexed, and results do not depend on the sample.

Results for odd input: vectors that are null, empty, or hold a null or non-finite component, and rows
with a null id take no part; vectors of different lengths do not meet, and each length is searched on
its own; components and scores beyond 64 bits become the nearest 64-bit integer; repeated rows count
each, and ties go to the smaller id; a query that no candidate is left for has no rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from quillspark.llm import scratch

SCALE, K = 1024, 10
SAMPLE, PIVOTS = 2048, 24
BLOCK, PART = 4096, 256
STEPS = (0.0, 0.25, 0.5, 1.0)  # radii of the annuli, as shares of the largest bound
EXACT, FITS = 2.0**52, 2.0**62  # sums that doubles and longs hold
SLACK = 1e-6  # relative, against rounding of distances


def quantised(vectors: DataFrame, id_column: str, column: str, scale: int) -> DataFrame:
    """``id, v``: rows that take part, as integers."""
    x = F.col("x")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    return rows.select("id", F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("bigint")).alias("v"))


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Sample rows, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that makes their squared length ``most``."""
    x = v.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _keyed(pivots: np.ndarray, most: float, dim: int):
    def run(batches):
        for batch in batches:
            d = _to_pivots(_lifted(_matrix(batch.column("v"), dim), most), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["id", "v", "pivot", "d"])

    return run


def _blocks(dim: int, block: int):
    """Packs rows sorted by pivot and distance; a block ends with its pivot, its size or its batch."""

    def run(batches):
        for n, batch in enumerate(batches):
            pivot, d = batch.column("pivot").to_numpy(), batch.column("d").to_numpy()
            ids, v = batch.column("id").to_numpy(), _matrix(batch.column("v"), dim)
            edge = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]])).tolist() + [len(pivot)]
            cuts = [(a, min(a + block, e)) for s, e in zip(edge, edge[1:]) for a in range(s, e, block)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pivot[a] for a, _ in cuts], pa.int32()), pa.array([d[a] for a, _ in cuts], pa.float64()), pa.array([d[b - 1] for _, b in cuts], pa.float64())]
                + [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (ids, d, v)],
                ["pivot", "low", "high", "ids", "ds", "vs"],
            )

    return run


def scores(rows: np.ndarray, queries: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products; all partial sums are at most ``most``.

    64-bit sums wrap, which leaves a result that fits right; those that may not fit are summed again
    in Python's integers.
    """
    if most < EXACT:
        return rows.astype(np.float64) @ queries.astype(np.float64).T
    found = rows @ queries.T
    if most >= FITS:
        for i, j in zip(*np.nonzero(np.abs(rows.astype(np.float64) @ queries.astype(np.float64).T) >= FITS)):
            exact = sum(x * y for x, y in zip(rows[i].tolist(), queries[j].tolist()))
            found[i, j] = min(max(exact, -(1 << 63)), (1 << 63) - 1)
    return found


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query: higher score, then smaller id."""
    order = np.lexsort((ids, ~score, query))  # the complement: a minimum has no negative
    query = query[order]
    new = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.bool_)
    at = np.arange(len(query))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    return order[rank < k]


def _search(dim: int, k: int, most: float, slack: float):
    """Scores a part of queries against a block, within the annuli the queries still need."""

    def run(batches):
        for batch in batches:
            query, who, score = [], [], []
            for n in range(len(batch)):
                ids, ds, v = (np.frombuffer(batch.column(c)[n].as_buffer(), t) for c, t in (("ids", np.int64), ("ds", np.float64), ("vs", np.int64)))
                part = batch.column("part")[n].values
                d, bound, own = (part.field(c).to_numpy(zero_copy_only=False) for c in ("d", "bound", "id"))
                a = np.searchsorted(ds, (d - bound).min() - slack, "left")
                b = np.searchsorted(ds, (d + bound).max() + slack, "right")
                if a >= b:
                    continue
                found = scores(v.reshape(-1, dim)[a:b], _matrix(part.field("v"), dim), most)
                other = ids[a:b, None] != own
                if b - a > k + 1:  # beside the query's own row
                    other &= found >= np.partition(found, b - a - k - 1, axis=0)[b - a - k - 1]
                row, column = np.nonzero(other)
                value = found[row, column].astype(np.int64)
                best = _best(own[column], ids[a:b][row], value, k)
                query.append(own[column][best])
                who.append(ids[a:b][row][best])
                score.append(value[best])
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (query, who, score)]
            best = _best(*columns, k)
            yield pa.RecordBatch.from_arrays([pa.array(c[best]) for c in columns], ["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Over.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet(queries: DataFrame, blocks: DataFrame, near: Column, part: int) -> DataFrame:
    """Blocks with the parts of queries that need them; a part holds about ``part`` queries."""
    spots = blocks.select("pivot", "low", "high", "block")
    pairs = queries.join(spots, "pivot").where(near).select("block", F.struct("id", "v", "d", "bound").alias("q"))
    many = pairs.groupBy("block").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("parts"))
    dealt = pairs.join(many, "block").withColumn("piece", F.pmod(F.xxhash64("q.id"), F.col("parts")))
    parts = dealt.groupBy("block", "piece").agg(F.collect_list("q").alias("part"))
    return parts.join(blocks, "block").select("ids", "ds", "vs", "part")


RESULT = "query_id bigint, vec_id bigint, score bigint"


def search(vectors: DataFrame, id_column: str, column: str, wanted: Column, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``wanted`` (a condition on ``id``)
    picks, the k other rows with the largest inner products."""
    rows = quantised(vectors, id_column, column, scale)
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("most"), F.max(wanted.cast("int")).alias("asked"))
    lengths = lengths.where("asked = 1 and n > 1").orderBy("dim").collect()  # a row for each length in use
    found = vectors.sparkSession.createDataFrame([], RESULT)
    for one in lengths:
        found = found.unionByName(_search_length(rows.where(F.size("v") == one["dim"]), wanted, one["dim"], one["n"], one["most"], k, pivots, block))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _index(rows: DataFrame, chosen: np.ndarray, dim: int, n: int, most: float, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``pivot, d``, blocks of them sorted by pivot and distance)."""
    keyed = scratch.save(rows.mapInArrow(_keyed(chosen, most, dim), "id bigint, v array<bigint>, pivot int, d double"), "keyed")
    # of equal vectors only the k + 1 with the smallest ids can be among any query's k best
    alike = Over.partitionBy("pivot", "d", "v").orderBy("id")
    needed = keyed.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1).drop("copy")
    dealt = needed.repartitionByRange(max(1, -(-n // (8 * block))), "pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")
    packed = dealt.mapInArrow(_blocks(dim, block), "pivot int, low double, high double, ids binary, ds binary, vs binary")
    return keyed, scratch.save(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _spread(chosen: np.ndarray, dim: int, most: float):
    """A row for each query and pivot with the distance between them and the query's bound."""

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            d = _to_pivots(np.column_stack([v.astype(np.float64), np.zeros(len(v))]), chosen)
            long = (v.astype(np.float64) ** 2).sum(1)
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            bound = np.sqrt(np.maximum(long + most - 2 * least, 0))
            bound[np.isnan(least)] = np.inf
            at = np.repeat(np.arange(len(v)), len(chosen))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(np.tile(np.arange(len(chosen), dtype=np.int32), len(v))), pa.array(d.reshape(-1)), pa.array(bound[at])],
                ["id", "v", "pivot", "d", "bound"],
            )

    return run


def _search_length(rows: DataFrame, wanted: Column, dim: int, n: int, most: float, k: int, pivots: int, block: int) -> DataFrame:
    """``query_id, vec_id, score``: the k best of each query and a few more, among vectors of one length."""
    slack = SLACK * (most**0.5 + 1)
    few = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    chosen = _pivots(_lifted(np.array([r["v"] for r in few], np.int64), most), pivots)
    keyed, blocks = _index(rows, chosen, dim, n, most, k, block)
    queries, edges = keyed.where(wanted).select("id", "v"), blocks.select("pivot", "low", "high")
    gap = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0))
    found, kth, radius, furthest = None, None, -1.0, 2 * most**0.5 + slack
    for share in STEPS:
        last, radius = radius, share * furthest if share < 1 else float("inf")
        asked = queries.join(kth, "id", "left") if kth is not None else queries.withColumn("least", F.lit(None))
        asked = asked.withColumn("least", F.col("least").cast("double")).mapInArrow(_spread(chosen, dim, most), "id bigint, v array<bigint>, pivot int, d double, bound double")
        near = (gap > last) & (gap <= radius) & (gap <= F.col("bound") + slack)
        if kth is not None and asked.join(edges, "pivot").where((gap > last) & (gap <= F.col("bound") + slack)).isEmpty():
            break
        step = scratch.save(_ranked(_meet(asked, blocks, near, PART).mapInArrow(_search(dim, k, most, slack), RESULT), k).drop("rank"), "step")
        found = step if found is None else found.unionByName(step)
        kth = _ranked(found, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select(F.col("query_id").alias("id"), "least")
        kth = scratch.save(kth, "kth")
        furthest = queries.join(kth, "id", "left").select(F.max(F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.lit(2 * most) - 2 * F.col("least").cast("double"))), F.lit(furthest)))).first()[0] or furthest
    return found
