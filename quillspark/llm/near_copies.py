"""Near copies by the Jaccard similarity of five-word shingles: all pairs at 0.8 or more, none missed.

A document is the set of 64-bit hashes of its shingles.  Sets are put in one order of all hashes,
common ones last.  Of two sets with similarity 0.8 or more, each has a hash of the other among its
first ``n - ceil(0.8 n) + 1``, so documents meet in the cells of these hashes.  A pair that meets
in too few cells for its lengths is below 0.8; the others' whole sets are compared, in integers.

Sets meet three times.  First those whose SimHash fingerprints, taken from the same hashes, differ in
three bits or fewer meet on the grid of segment bit counts (``simhash_dedup.link``), and are held against
0.8 like all others.  Texts at 0.8 may lie 4 to 11 bits apart, so those with one MinHash are sorted by
size, for several MinHashes, and each is linked with the likeliest of the few before it and of the few
smallest: counts of its hashes by their low bits, 64 of them, are a vector whose Manhattan distance to
another is at most the number of hashes that one set has alone.  This joins most of a dense group with a
few links for each set.  Then sets meet in the cells of their first hashes, but only those that the links
before have not joined, so a group of copies never yields all its pairs.  Which hashes are common is read
from a sample; the sample and the meetings before the last bear on the work alone, the last finds what
they leave.

Results for odd input: texts under five words are one shingle; null and empty texts are copies of
each other; a row with a null ``doc_id`` links nothing and stays; rows of one ``doc_id`` count as
one document; other columns are kept and ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import components, scratch, simhash_dedup
from quillspark.llm import words as W

SHINGLE = 5
SEED = 42
SAMPLE, SEEN, COMMON = 32, 8, 1 << 16
ORDERS, AHEAD, COUNTS, FINE = 4, 8, 64, 256
BITS_OF = 1 << 12
_SALTS = np.array([0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1 for k in range(ORDERS)], np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's word shingles, as sorted signed integers."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < shingle:
        rows = [b" ".join(words)]
    else:
        rows = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, seed) for r in rows), np.uint64).view(np.int64))


def _fingerprint(found: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for start in range(0, len(found), BITS_OF):
        count += np.unpackbits(found[start : start + BITS_OF].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(found), bitorder="little").view(np.uint64)[0])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))


def _read(batches):
    """Ids and sets of a few hundred rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield part.column("doc_id"), [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column("text").cast(pa.binary())]


def sets(docs: DataFrame) -> DataFrame:
    """``doc_id, hashes`` for each row with an id."""

    def run(batches):
        for ids, found in _read(batches):
            yield pa.RecordBatch.from_arrays([ids, _lists(found)], ["doc_id", "hashes"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, hashes array<bigint>")


def firsts(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``doc_id, key, fp, n, hashes, mins, counts, fine`` for each row with an id: a set's fingerprint, its first
    hashes, its least hash in each order, its hashes counted by their low 6 and 8 bits; equal sets have equal keys."""

    def first(found):
        n, late = len(found), np.isin(found, common) if len(common) else np.zeros(len(found), np.bool_)
        return np.concatenate([found[~late], found[late]])[: n - (4 * n + 4) // 5 + 1]

    def least(found):
        return np.array([W.mix(found.view(np.uint64) ^ salt).min() if len(found) else 0 for salt in _SALTS], np.uint64).view(np.int64)

    def counts(found):
        return np.bincount(found & (FINE - 1), minlength=FINE).astype(np.uint8)

    def run(batches):
        for ids, found in _read(batches):
            keys, n = pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary()), pa.array([len(f) for f in found], pa.int32())
            fine = [counts(f) for f in found]
            prints = pa.array(np.array([_fingerprint(f) for f in found], np.uint64).view(np.int64))
            columns = [ids, keys, prints, n, _lists([first(f) for f in found]), _lists([least(f) for f in found]), pa.array([f.reshape(-1, COUNTS).sum(0, np.uint8).tobytes() for f in fine], pa.binary()), pa.array([f.tobytes() for f in fine], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp", "n", "hashes", "mins", "counts", "fine"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, key binary, fp bigint, n int, hashes array<bigint>, mins array<bigint>, counts binary, fine binary")


def _likely(batches):
    """Reads rows sorted by order, least hash and n; yields the likeliest links of each row to the
    few before it and to the few smallest sets with its least hash.

    Counts are kept modulo 256, whose circular differences are no larger than the true ones.
    """
    heads = None
    for batch in batches:
        order, least, node, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("order", "least", "node", "n"))
        if not len(node):
            continue
        counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint8).reshape(-1, COUNTS)
        rows = [order, least, node, n, counts]
        if heads is not None:  # the group that the last batch ended in
            rows = [np.concatenate(x) for x in zip(heads, rows)]
        order, least, node, n, counts = rows
        new = np.ones(len(node), np.bool_)
        new[1:] = (order[1:] != order[:-1]) | (least[1:] != least[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))
        for others in ([np.arange(len(node)) - d for d in range(1, AHEAD + 1)], [first + d for d in range(AHEAD)]):
            best, at = np.full(len(node), np.iinfo(np.int64).max), np.full(len(node), -1)
            for other in others:
                own = np.flatnonzero((other >= first) & (other < np.arange(len(node))))
                other = other[own]
                apart = counts[own] - counts[other]
                apart = np.minimum(apart, -apart).sum(1, dtype=np.int64)
                good = (9 * apart <= n[own] + n[other]) & (5 * n[other] >= 4 * n[own]) & (apart < best[own]) & (node[own] != node[other])
                best[own[good]], at[own[good]] = apart[good], other[good]
            u = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[u], node[at[u]], best[u] * 1000 // (n[u] + n[at[u]]))], ["node", "other", "apart"])
        last = int(first[-1])
        keep = np.unique(np.concatenate([np.arange(last, min(last + AHEAD, len(node))), np.arange(max(last, len(node) - AHEAD), len(node))]))
        heads = [x[keep] for x in rows]


def _meetings(batches):
    """Reads rows sorted by hash, n and node; yields a row for each meeting of two that may be near."""
    names = ["u", "v", "nu", "nv"]

    def pairs(code, n, root, node):
        at, d = np.arange(len(code)), 0
        while len(at):
            d += 1
            at = at[at + d < len(code)]
            at = at[(code[at] == code[at + d]) & (5 * n[at].astype(np.int64) >= 4 * n[at + d].astype(np.int64))]  # both end a run
            met = at[(root[at] != root[at + d]) & (node[at] != node[at + d])]
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[met], node[met + d], n[met], n[met + d])], names)

    rest = None
    for batch in batches:
        part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "n", "root", "node")]
        if not len(part[0]):
            continue
        if rest is not None:
            part = [np.concatenate(x) for x in zip(rest, part)]
        end = int(np.flatnonzero(part[0] == part[0][-1])[0])
        yield from pairs(*(x[:end] for x in part))
        rest = [x[end:] for x in part]
    if rest is not None:
        yield from pairs(*rest)


def _apart(batches):
    """Drops the pairs whose counts alone keep them below 0.8."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in ("a", "b"))
        n = batch.column("nu").to_numpy().astype(np.int64) + batch.column("nv").to_numpy()
        near = np.flatnonzero(9 * np.minimum(a - b, b - a).sum(1, dtype=np.int64) <= n)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(near)) for c in ("u", "v")], ["u", "v"])


def _verified(docs: DataFrame, pairs: DataFrame, tag: str) -> DataFrame:
    """The pairs whose whole sets are at 0.8 or more."""
    pairs = scratch.save(pairs, f"{tag}-pairs")
    ends = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    whole = scratch.save(sets(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).join(ends, "doc_id", "left_semi")), f"{tag}-sets")
    one = lambda end, c: whole.select(F.col("doc_id").alias(end), F.col("hashes").alias(c))
    both = pairs.join(one("u", "a"), "u").join(one("v", "b"), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return scratch.save(both.where(9 * shared >= 4 * (F.size("a") + F.size("b"))).select("u", "v").distinct(), f"{tag}-links")


def by_bits(nodes: DataFrame) -> DataFrame:
    """``u, v``: links that connect all nodes whose fingerprints differ in three bits or fewer."""
    heads = scratch.save(nodes.groupBy("fp").agg(F.min("node").alias("node")), "heads")
    equal = nodes.select("fp", F.col("node").alias("v")).join(heads.withColumnRenamed("node", "u"), "fp").where("u != v")
    near = simhash_dedup.link(heads).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return equal.select("u", "v").unionByName(near)


def _neighbours(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between sets whose fingerprints are close, or that share a MinHash."""
    at = F.posexplode("mins").alias("order", "least")
    keys = ["order", "least", "n", "node"]
    rows = nodes.select("node", "n", "counts", at).repartitionByRange(*keys).sortWithinPartitions(*keys)
    likely = rows.select("order", "least", "node", "n", "counts").mapInArrow(_likely, "node bigint, other bigint, apart bigint")
    # 2 * ORDERS rows at most for each node, of which the two likeliest
    best = likely.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct("apart", "other"))), 1, 2).alias("best"))
    pairs = best.select("node", F.explode("best.other").alias("other")).select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))
    return _verified(docs, pairs.unionByName(by_bits(nodes.select("fp", "node"))).distinct(), "first")


def _near(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links ``u, v`` between sets at 0.8 or more of different roots; ``nodes`` has ``node, root, n, hashes``."""
    cells = nodes.select(F.explode("hashes").alias("hash"), "n", "root", "node").repartition("hash").sortWithinPartitions("hash", "n", "node")
    met = cells.mapInArrow(_meetings, "u bigint, v bigint, nu int, nv int")
    # beyond the first hashes two sets share ceil(0.8 n) - 1 at most, n the larger of both lengths
    enough = "9 * (count(*) + (4 * nv + 4) div 5 - 1) >= 4 * (nu + nv)"
    pairs = met.groupBy("u", "v", "nu", "nv").agg(F.expr(enough).alias("enough")).where("enough")
    one = lambda end, c: nodes.select(F.col("node").alias(end), F.col("fine").alias(c))
    pairs = pairs.join(one("u", "a"), "u").join(one("v", "b"), "v").select("u", "v", "nu", "nv", "a", "b")
    return _verified(docs, pairs.mapInArrow(_apart, "u bigint, v bigint"), "second")


def links(docs: DataFrame) -> DataFrame:
    """Links ``u, v`` between ids, enough to connect all documents at 0.8 or more."""
    some = sets(docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)).dropDuplicates(["hashes"])
    often = some.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("seen")).where(F.col("seen") >= SEEN)
    common = np.array([r["hash"] for r in often.orderBy(F.desc("seen"), "hash").limit(COMMON).select("hash").collect()], np.int64)
    rows = scratch.save(firsts(docs, common), "firsts")
    least = scratch.save(rows.groupBy("key").agg(F.min("doc_id").alias("node")), "least")
    # joined by id alone, so that the join with roots below needs no further exchange
    named = rows.join(least.select(F.col("key").alias("own"), F.col("node").alias("doc_id")), "doc_id").where("key = own")
    nodes = named.select(F.col("doc_id").alias("node"), "fp", "n", "hashes", "mins", "counts", "fine")
    copies = rows.select("doc_id", "key").join(least, "key").where("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    first = copies.unionByName(_neighbours(docs, nodes))
    roots = components.components(first)
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return first.unionByName(_near(docs, joined))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns: of each group the rows with the smallest id, and null ids."""
    (mine,) = scratch.fresh(docs, "gone")
    gone = components.components(links(docs)).select(F.col("node").alias(mine))
    return docs.join(gone, docs["doc_id"].cast("bigint") == F.col(mine), "left_anti")
