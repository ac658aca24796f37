"""Ranked lexical search in a forward index of document blocks with a maximum for each term.

Items (queries) are taken in slices of about ``slice_terms`` terms, which bounds what tasks are sent.
For a slice one pass over the whole texts writes blocks: ranges of ``block`` consecutive documents
with their lengths and the slice's terms in them; counts over all documents come from it.  A second
pass puts each term's impact in the place of its count, and beside each block the terms' maxima.

An item's bound in a block is the sum of its weighted maxima.  From the maxima alone, which are
columns of their own, the ``seeds`` blocks of the highest bound are found over all tasks and scored;
an item's tenth place there is a threshold that holds everywhere.  Then each task sorts its blocks
by the item's bound and scores them from the highest down until the bound is below the threshold,
which its own finds raise.  Equal scores go to the smaller document, so a block of equal bound with
larger documents only is passed over too.

Results for odd input: a null text has no terms; of several rows of an item the terms are taken
together; rows with a null ``item_id`` and items without terms give nothing; documents with a null
id count like others and rank after others of their score, with a null ``doc_id``; repeated rows are
documents each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from quillspark.llm import scratch, words

BLOCK = 64
SLICE = 200_000
SEEDS = 4
K = 10
NO_ID = (1 << 63) - 1
# A term's bytes as they count, A-Z in lower case; a space between terms.
_BYTES = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_BYTES[65:91] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts, one after the other, and the number of each text's first (one more at the end)."""
    plain = _BYTES[data]
    starts, ends, first = words.spans(plain, offsets)
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(plain[plain != 32])])
    return found, first


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term`` (lower-case bytes), each once."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in words.slices(batch.column("text")):
                found, first = terms(data, offsets)
                ids = batch.column("item_id").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), np.diff(first))))
                yield pa.RecordBatch.from_arrays([ids, found], ["item_id", "term"])

    whole = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return whole.mapInArrow(run, "item_id bigint, term binary").distinct()


INDEX = "block bigint, least bigint, n_docs bigint, n_terms bigint, docs binary, sizes binary, doc binary, term binary, tf binary, terms array<int>, dfs array<int>"


def index(docs: DataFrame, vocabulary: list[bytes], block: int = BLOCK) -> DataFrame:
    """The forward index: a row for each block of documents that have a term."""

    def run(batches):
        known, number = pa.array(vocabulary, pa.binary()), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offsets in words.slices(batch.column("text")):
                found, first = terms(data, offsets)
                size = np.diff(first)
                ids = batch.column("doc_id").slice(a, b - a).fill_null(NO_ID).to_numpy()
                hit = pc.index_in(found, known)
                at = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
                code = np.repeat(np.arange(b - a), size)[at] * len(vocabulary) + hit.drop_null().to_numpy()
                code, tf = np.unique(code, return_counts=True)
                doc, term = np.divmod(code, max(1, len(vocabulary)))
                for low in range(0, b - a, block):
                    high = min(low + block, b - a)
                    n = size[low:high]
                    if not n.any():
                        continue
                    p, q = np.searchsorted(doc, (low, high))
                    own, df = np.unique(term[p:q], return_counts=True)
                    parts = (ids[low:high], "<i8"), (n, "<i8"), (doc[p:q] - low, "<i4"), (term[p:q], "<i4"), (tf[p:q], "<i4")
                    row = [number, int(ids[low:high][n > 0].min()), int((n > 0).sum()), int(n.sum()), *(x.astype(kind).tobytes() for x, kind in parts), own.tolist(), df.tolist()]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)
                    number += 1

    names = [c.split()[0] for c in INDEX.split(", ")]
    schema = pa.schema([(c, pa.int64()) for c in names[:4]] + [(c, pa.binary()) for c in names[4:9]] + [(c, pa.list_(pa.int32())) for c in names[9:]])
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return whole.mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Corpus:
    """Counts over all documents: how many have terms, all their terms, and each term's weight."""

    n: int
    length: int
    weight: np.ndarray

    def impact(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 100 - 90 + 90 * size * self.n // self.length
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def corpus(blocks: DataFrame, size: int) -> Corpus:
    """``size`` is the vocabulary's, which bounds what is collected."""
    n, length = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    weight = np.zeros(size)
    each = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    for r in each.collect():
        weight[r["terms"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    return Corpus(n or 0, length or 0, weight)


def maxima(blocks: DataFrame, counts: Corpus) -> DataFrame:
    """The index with impacts, and each block's maximum for each of its terms."""

    def run(batches):
        for batch in batches:
            sizes, doc, term, tf = (batch.column(c) for c in ("sizes", "doc", "term", "tf"))
            impacts, tops = [], []
            for k in range(len(batch)):
                n, d, t, f = (np.frombuffer(c[k].as_buffer(), kind) for c, kind in ((sizes, "<i8"), (doc, "<i4"), (term, "<i4"), (tf, "<i4")))
                impact = counts.impact(f.astype(np.int64), n[d])
                own, place = np.unique(t, return_inverse=True)
                top = np.zeros(len(own), np.int64)
                np.maximum.at(top, place, impact)
                impacts.append(impact.astype("<i4").tobytes())
                tops.append(top.astype("<i4").tobytes())
            kept = [batch.column(c) for c in ("block", "least", "docs", "doc", "term")]
            terms = pa.array([np.unique(np.frombuffer(t.as_buffer(), "<i4")).tobytes() for t in term], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(impacts, pa.binary()), terms, pa.array(tops, pa.binary())], ["block", "least", "docs", "doc", "term", "impact", "terms", "tops"])

    return blocks.select("block", "least", "docs", "sizes", "doc", "term", "tf").mapInArrow(run, "block bigint, least bigint, docs binary, doc binary, term binary, impact binary, terms binary, tops binary")


Items = list[tuple[int, np.ndarray]]  # (item, numbers of its terms)


def bounds(batch: pa.RecordBatch):
    """A function from all terms' weights for an item to the bound of each block of the batch."""
    one = [[np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(c)] for c in ("terms", "tops")]
    term, top = (np.concatenate(x) for x in one)
    block = np.repeat(np.arange(len(batch)), [len(x) for x in one[0]])
    return lambda weight: np.bincount(block, top * weight[term], len(batch))  # whole numbers below 2^53


def best_blocks(blocks: DataFrame, items: Items, counts: Corpus, seeds: int = SEEDS) -> DataFrame:
    """``item, block``: the blocks of the highest bound for each item, ``seeds`` of them."""

    def run(batches):
        found: list[list[tuple[float, int, int]]] = [[] for _ in items]
        weight = np.zeros(len(counts.weight))
        for batch in batches:
            bound, names, least = bounds(batch), batch.column("block").to_pylist(), batch.column("least").to_pylist()
            for k, (_, own) in enumerate(items):
                weight[own] = counts.weight[own]
                b = bound(weight)
                weight[own] = 0
                top = np.argpartition(-b, min(seeds, len(b)) - 1)[:seeds]
                found[k] = sorted([*found[k], *((-b[i], least[i], names[i]) for i in top.tolist() if b[i] > 0)])[:seeds]
        rows = [(item, int(-b), low, name) for (item, _), own in zip(items, found) for b, low, name in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, ["item", "bound", "least", "block"])

    each = blocks.select("block", "least", "terms", "tops").mapInArrow(run, "item bigint, bound bigint, least bigint, block bigint")
    place = F.row_number().over(Over.partitionBy("item").orderBy(F.desc("bound"), "least", "block"))
    return each.withColumn("place", place).where(F.col("place") <= seeds).select("item", "block")


def scored(blocks: DataFrame, items: Items, counts: Corpus, least: dict[int, tuple[int, int]], k: int = K) -> DataFrame:
    """``item, doc, score`` of what can be among the first ``k``, by tasks.  ``least`` has the
    (score, document) of an item's k-th place as far as it is known; what ranks below it goes."""

    def run(batches):
        found: list[list[tuple[int, int]]] = [[] for _ in items]  # (-score, doc), the best first
        weight = np.zeros(len(counts.weight))
        for batch in batches:
            bound, low = bounds(batch), batch.column("least").to_numpy()
            parts = [[np.frombuffer(x.as_buffer(), kind) for x in batch.column(c)] for c, kind in (("docs", "<i8"), ("doc", "<i4"), ("term", "<i4"), ("impact", "<i4"))]
            for n, (item, own) in enumerate(items):
                weight[own] = counts.weight[own]
                b, best = bound(weight), found[n]
                limit = min([(-least[item][0], least[item][1])] if item in least else [(-1, NO_ID)])
                for i in np.lexsort((low, -b)).tolist():
                    last = min(limit, best[-1]) if len(best) == k else limit
                    if (-b[i], low[i]) > last:
                        break
                    docs, doc, term, impact = (x[i] for x in parts)
                    score = np.bincount(doc, impact * weight[term], len(docs)).astype(np.int64)
                    for d in np.flatnonzero(score >= -last[0]).tolist():
                        pair = (-int(score[d]), int(docs[d]))
                        if pair <= limit and (len(best) < k or pair < best[-1]):
                            bisect.insort(best, pair)
                            del best[k:]
                weight[own] = 0
        rows = [(item, doc, -score) for (item, _), own in zip(items, found) for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3, ["item", "doc", "score"])

    return blocks.select("least", "docs", "doc", "term", "impact", "terms", "tops").mapInArrow(run, "item bigint, doc bigint, score bigint")


def first(found: DataFrame, k: int = K) -> DataFrame:
    """``item, rank, doc, score``: the ``k`` highest scores of each item."""
    rank = F.row_number().over(Over.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, slice_terms: int = SLICE, seeds: int = SEEDS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest scores above 0 for each item."""
    spark = docs.sparkSession
    asked = scratch.save(item_terms(items), "items")
    slices = max(1, -(-asked.count() // slice_terms))
    out = spark.createDataFrame([], "item bigint, rank int, doc bigint, score bigint")
    for part in range(slices):
        own: dict[int, list[bytes]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == part).collect():
            own.setdefault(r["item_id"], []).append(bytes(r["term"]))
        vocabulary = sorted({t for terms in own.values() for t in terms})
        if not vocabulary:
            continue
        number = {t: n for n, t in enumerate(vocabulary)}
        wanted = [(item, np.array(sorted(number[t] for t in found))) for item, found in sorted(own.items())]
        plain = scratch.save(index(docs, vocabulary, block), "index")
        counts = corpus(plain, len(vocabulary))
        if not counts.n:
            continue
        blocks = scratch.save(maxima(plain, counts), "blocks")
        scratch.drop(plain)
        # no more rows than seeds for each item of the slice
        start = F.broadcast(best_blocks(blocks, wanted, counts, seeds).select("block").distinct())
        least: dict[int, tuple[int, int]] = {}
        for r in first(scored(blocks.join(start, "block", "left_semi"), wanted, counts, {}, k), k).where(F.col("rank") == k).collect():
            least[r["item"]] = r["score"], r["doc"]
        best = scratch.save(first(scored(blocks, wanted, counts, least, k), k), "ranked")
        scratch.drop(blocks)
        out = best if slices == 1 else out.unionByName(best)
    return out.select(F.col("item").alias("item_id"), "rank", F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score")
