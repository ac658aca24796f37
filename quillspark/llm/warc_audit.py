"""WARC records and a Merkle audit of replicas of WARC files.

Every record is hashed with its offset range.  ``FANOUT`` neighbours make a node, nodes of a file
make nodes again up to the file's root, and file roots are joined in the same way up to one root
for each replica.  Two replicas are compared from the root: only children of nodes that differ are
joined at the next level, so equal parts of the replicas cost nothing below the node that shows it.

All of it is DataFrame operations; a task holds ``FANOUT`` children of a node at most.

Results for odd input: a null file, offset or hash is a value like any other; a record that one
replica lacks is ``missing`` or ``extra``; records that repeat at one offset are told apart by
their place in order; empty replicas differ in nothing; other columns are ignored.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from quillspark.llm import scratch

FANOUT = 16
DATE = "2024-01-01T00:00:00Z"


def record(uri: Column, identity: Column, payload: Column, date: str = DATE) -> Column:
    """The text of a WARC resource record; nulls are empty."""
    body = F.coalesce(payload.cast("string"), F.lit(""))
    head = [
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(identity.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.coalesce(uri.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def parse(files: DataFrame) -> DataFrame:
    """``file, offset, length, kind, uri, payload, sha`` of each record of WARC files, given as
    ``path, content`` rows (Spark's binaryFile source).  Gzip members are read too; offsets are
    then those of the unpacked bytes.  A file that ends within a record raises ValueError."""

    def run(batches):
        import hashlib

        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                at, rows = 0, []
                while at < len(data):
                    end = data.find(b"\r\n\r\n", at)
                    if end < 0 or not data.startswith(b"WARC/", at):
                        raise ValueError(f"no record at byte {at} of {path}")
                    fields = dict(x.split(":", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
                    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
                    start = end + 4
                    stop = start + int(fields["content-length"])
                    if data[stop : stop + 4] != b"\r\n\r\n":
                        raise ValueError(f"the record at byte {at} of {path} ends early")
                    rows.append((path, at, stop + 4 - at, fields.get("warc-type"), fields.get("warc-target-uri"), data[start:stop], hashlib.sha256(data[at : stop + 4]).hexdigest()))
                    at = stop + 4
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "offset", "length", "kind", "uri", "payload", "sha"])

    return files.select("path", "content").mapInArrow(run, "file string, offset bigint, length bigint, kind string, uri string, payload binary, sha string")


def assemble(records: DataFrame) -> DataFrame:
    """``file, content``: the bytes of each file from ``file, offset, record`` rows."""
    inside = F.sort_array(F.collect_list(F.struct("offset", F.col("record").cast("binary").alias("record"))))
    return records.groupBy("file").agg(F.aggregate(inside, F.lit(b""), lambda s, r: F.concat(s, r["record"])).alias("content"))


def inventory(rows: DataFrame, file: Column, order: list[Column], text: Column) -> DataFrame:
    """``file, offset, length, sha`` of records laid out in order, file by file."""
    hashed = rows.select(file.alias("file"), *(c.alias(f"o{k}") for k, c in enumerate(order)), F.octet_length(text).cast("bigint").alias("length"), F.sha2(text.cast("binary"), 256).alias("sha"))
    before = Over.partitionBy("file").orderBy(*(f"o{k}" for k in range(len(order))), "sha").rowsBetween(Over.unboundedPreceding, -1)
    return hashed.select("file", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"), "length", "sha")


def _leaves(replica: DataFrame) -> DataFrame:
    """Leaf nodes: number of the file (a hash of its name), place in it, hash, and the record."""
    told = replica.select("file", "offset", "length", "sha", F.xxhash64("file").alias("number"))
    place = F.row_number().over(Over.partitionBy("number").orderBy("offset", "length", "sha")) - 1
    value = F.sha2(F.concat_ws("|", F.lit("leaf"), F.coalesce(F.col("offset").cast("string"), F.lit("-")), F.coalesce(F.col("length").cast("string"), F.lit("-")), F.coalesce("sha", F.lit("-"))), 256)
    return told.select("number", place.cast("bigint").alias("place"), value.alias("hash"), "file", "offset", "length", "sha")


class _Shape:
    """Levels of a tree: leaves to a file's root in ``within`` steps; then files are dealt to
    buckets by the hash of their names, about ``FANOUT`` to each, and buckets joined in turn."""

    def __init__(self, longest: int, files: int):
        self.within = _steps(longest)
        self.digits = max(0, _steps(files) - 1)
        self.levels = self.within + 1 + self.digits

    def up(self, level: int) -> tuple[Column, Column]:
        """(number, place) of the parent of a node of ``level``."""
        if level < self.within:
            return F.col("number"), F.floor(F.col("place") / FANOUT).cast("bigint")
        if level == self.within:
            return F.pmod(F.col("number"), F.lit(FANOUT**self.digits)).cast("bigint"), F.lit(0).cast("bigint")
        return F.floor(F.col("number") / FANOUT).cast("bigint"), F.lit(0).cast("bigint")


def _parents(level: DataFrame, number: Column, place: Column) -> DataFrame:
    child = F.struct(F.col("number").alias("n"), F.col("place").alias("p"), "hash")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("child")), lambda c: F.concat_ws(":", c["n"].cast("string"), c["p"].cast("string"), c["hash"])), "|")
    return level.select(number.alias("number"), place.alias("place"), child.alias("child")).groupBy("number", "place").agg(F.sha2(F.concat(F.lit("node|"), joined), 256).alias("hash"))


def _tree(leaves: DataFrame, shape: _Shape, levels: int) -> list[DataFrame]:
    out = [leaves]
    for k in range(levels):
        out.append(scratch.save(_parents(out[-1].select("number", "place", "hash"), *shape.up(k)), f"level{k + 1}"))
    return out


def _steps(count: int) -> int:
    steps = 0
    while count > 1:
        count, steps = -(-count // FANOUT), steps + 1
    return steps


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Where two replicas (``file, offset, length, sha``) differ: ``file, place, kind`` and each
    replica's offset, length and sha.  ``kind`` is altered, moved (equal records, other offsets),
    missing (from the second) or extra (in the second)."""
    sides = [scratch.save(_leaves(x), "leaves") for x in (first, second)]
    longest = max(int(x.agg(F.max("place").alias("m")).first()["m"] or 0) + 1 for x in sides)
    files = sides[0].select("number").union(sides[1].select("number")).distinct().count()
    shape = _Shape(longest, files)
    one, two = (_tree(x, shape, shape.levels) for x in sides)
    differ = None
    for k in range(shape.levels, -1, -1):
        a, b = one[k], two[k]
        if differ is not None:
            number, place = shape.up(k)
            a, b = (x.withColumn("up_n", number).withColumn("up_p", place).join(differ, ["up_n", "up_p"], "left_semi").drop("up_n", "up_p") for x in (a, b))
        a, b = (x.select("number", "place", *(F.col(c).alias(f"{c}_{s}") for c in x.columns[2:])) for x, s in ((a, "a"), (b, "b")))
        off = a.join(b, ["number", "place"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        if k:
            differ = scratch.save(off.select(F.col("number").alias("up_n"), F.col("place").alias("up_p")), "differ")
    kind = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").when(F.col("sha_a").eqNullSafe(F.col("sha_b")), "moved").otherwise("altered")
    return off.select(F.coalesce("file_a", "file_b").alias("file"), "place", kind.alias("kind"), *(f"{c}_{s}" for s in "ab" for c in ("offset", "length", "sha")))


def roots(replica: DataFrame) -> DataFrame:
    """``number, root``: the root of each file's tree (all of one height) by the hash of its name."""
    leaves = scratch.save(_leaves(replica), "leaves")
    shape = _Shape(int(leaves.agg(F.max("place").alias("m")).first()["m"] or 0) + 1, 1)
    return _tree(leaves, shape, shape.within)[-1].select("number", F.col("hash").alias("root"))
