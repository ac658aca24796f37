"""Near-duplicate groups by SimHash fingerprints and a grid over segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits; the counts of set bits in them are a
vector whose Manhattan distance to another is at most the number of differing bits.  The 32
coordinates form six blocks.  Vectors within distance 3 differ in three blocks at most, so they
fall into one grid cell for at least one of the 20 choices of three blocks.  Rows meet in those
cells, are held against the Manhattan bound and then verified bit by bit.

Equal fingerprints are one node throughout.  A cell with more than ``CELL`` fingerprints is dealt
into parts, and every pair of parts is compared in a task of its own; a task reports a spanning
forest of the links it sees, so a dense cell never yields all its pairs.

Results for odd input: a null or empty text has fingerprint zero and is linked like any other; a
row with a null ``doc_id`` has a fingerprint, links nothing and has a null ``component_id``;
repeated rows give equal rows; rows of one ``doc_id`` count as one document; other columns are
ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import components, scratch

SHINGLE = 3
BITS = 3
SEED = 42
CELL = 512
CHUNK = 1 << 15
_EDGES = (0, 6, 11, 16, 21, 26, 32)
_LOW = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        rows, n = iter([b" ".join(words)]), 1
    else:
        rows, n = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle)))), len(words) - shingle + 1
    count = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        many = min(CHUNK, n - start)
        hashes = np.fromiter((xxhash.xxh64_intdigest(r, seed) for r in itertools.islice(rows, many)), np.uint64, many)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` for each row; ``fp`` is the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, seed) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def embed(fp: np.ndarray) -> np.ndarray:
    """The counts of set bits in the 32 segments, two bits each, in one integer."""
    return (fp & _LOW) + ((fp >> np.uint64(1)) & _LOW)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the coordinates' differences (0 to 2 each) of packed vectors."""
    ones, twos = x & _LOW, (x >> np.uint64(1)) & _LOW
    ones_y, twos_y = y & _LOW, (y >> np.uint64(1)) & _LOW
    odd = ones ^ ones_y
    far = ~odd & (twos ^ twos_y)
    return np.bitwise_count(odd & _LOW) + 2 * np.bitwise_count(far & _LOW)


def grid(nodes: DataFrame) -> DataFrame:
    """A row ``choice, cell, fp, node`` for each node and choice of three blocks."""
    low = F.lit(int(_LOW))
    even, odd = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    vector = F.shiftleft(even.bitwiseAND(odd), 1).bitwiseOR(even.bitwiseXOR(odd))  # their sums, without a carry
    masks = [sum(3 << (2 * i) for i in range(a, b)) for a, b in zip(_EDGES, _EDGES[1:])]
    chosen = [sum(c) for c in itertools.combinations(masks, 3)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    cells = F.array(*(F.struct(F.lit(k).cast("tinyint").alias("choice"), F.col("vector").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(signed)))
    return nodes.withColumn("vector", vector).select("fp", "node", F.explode(cells).alias("at")).select("at.choice", "at.cell", "fp", "node")


def _forest(u: np.ndarray, v: np.ndarray) -> list[int]:
    """Places of the links that join two trees, in turn."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    kept = []
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        a, b = top(a), top(b)
        if a != b:
            above[a] = b
            kept.append(k)
    return kept


def _links(bits: int):
    """Reads rows sorted by group and yields the links of a spanning forest of each group."""

    def links(group, fp, node):
        us, vs = [], []
        vector = embed(fp)
        for d in range(1, len(group)):
            same = np.flatnonzero(group[d:] == group[:-d])
            if not len(same):
                break
            near = same[manhattan(vector[same], vector[same + d]) <= bits]
            near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= bits]
            us.append(near)
            vs.append(near + d)
        u = np.concatenate(us) if us else np.zeros(0, np.int64)
        v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
        kept = _forest(u, v)
        return pa.RecordBatch.from_arrays([pa.array(node[u[kept]]), pa.array(node[v[kept]])], ["u", "v"])

    def run(batches):
        rest = None
        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "cell", "left", "right", "fp", "node")]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            new = np.ones(len(part[0]), np.bool_)
            new[1:] = np.any([x[1:] != x[:-1] for x in part[:4]], axis=0)
            group = np.cumsum(new)
            end = int(np.searchsorted(group, group[-1])) if len(group) else 0
            yield links(group[:end], part[4][:end].view(np.uint64), part[5][:end])
            rest = [x[end:] for x in part]
        if rest is not None and len(rest[0]):
            yield links(np.zeros(len(rest[0]), np.int64), rest[4].view(np.uint64), rest[5])

    return run


def link(nodes: DataFrame, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """Links ``u, v`` between nodes ``(fp, node)``, enough to connect all that lie within ``bits``."""
    rows = grid(nodes)
    full = rows.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1")
    full = scratch.save(full, "cells")
    met = rows.join(full, ["choice", "cell"])
    parts = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("own", k).alias("left"), F.greatest("own", k).alias("right")))
    met = met.withColumn("parts", parts).withColumn("own", own).select("choice", "cell", "fp", "node", F.explode(pair).alias("at"))
    keys = ["choice", "cell", "left", "right"]
    met = met.select("choice", "cell", "at.left", "at.right", "fp", "node").repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(_links(bits), "u bigint, v bigint")


def groups(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``."""
    if not 0 <= bits <= 3:
        raise ValueError("the grid finds all links of 3 or fewer differing bits")
    rows = scratch.save(fingerprints(docs, shingle), "fingerprints")
    nodes = scratch.save(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components.components(link(nodes, bits))
    known = nodes.join(roots, "node", "left").select(F.col("fp"), F.coalesce("root", "node").alias("root"))
    known = scratch.save(known, "roots")
    return rows.join(known, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``."""
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns: of each group the rows with the smallest id, and null ids."""
    (mine,) = scratch.fresh(docs, "kept")
    kept = groups(docs).where("doc_id = component_id").select(F.col("doc_id").alias(mine)).distinct()
    ids = docs["doc_id"].cast("bigint")
    named = docs.join(kept, ids == F.col(mine), "left_semi")
    return named.unionByName(docs.where(ids.isNull()))
