"""Packing of token sequences into rows of one length: dominance reduction, then best fit.

The packing depends on how many pieces there are of each length alone, so it is worked out on a
histogram of at most ``size`` counts, whatever the input's size.  Piece sets that provably
dominate all others are fixed first (the reduction procedure of Martello and Toth): full pieces,
pairs that fill a row, pieces that nothing fits with, and pairs whose second piece is as long as
any set that fits.  Best fit in descending order packs the rest.  All rows with equal contents are
one pattern with a count.

Pieces then find their place by their rank among the pieces of their length, so no task holds
more than a bucket of them and the plan that is sent to the tasks has a bounded size.

Results for odd input: a null or empty text is the end token alone; a row with a null ``doc_id`` is
packed like any other; repeated rows are packed each; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from quillspark.llm import scratch, word_tokens

SIZE = 2048
END = 0
BUCKET = 100_000
BATCH = 64
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False, task_words: int | None = None) -> DataFrame:
    """A row for each piece of each document; ``ids`` (unsigned little-endian) if asked for.

    Workers keep the tokenizer and the words that they have seen.  With ``task_words`` a task has its
    own, with a cache of about so many words, and gives its memory back when it ends.
    """

    def run(batches):
        encoder = word_tokens.tokenizer(path) if task_words is None else word_tokens.WordTokenizer(path, task_words)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            texts, ids = batch.column("text").cast(pa.binary()), batch.column("doc_id")
            for k in range(0, len(batch), BATCH):
                found = encoder.encode([t or b"" for t in texts.slice(k, BATCH).to_pylist()])
                row, number, start, length, crc, own = [], [], [], [], [], []
                for i, x in enumerate(found):
                    x += last
                    for piece, a in enumerate(range(0, len(x), 4 * size)):
                        y = x[a : a + 4 * size]
                        row.append(i)
                        number.append(piece)
                        start.append(a // 4)
                        length.append(len(y) // 4)
                        crc.append(zlib.crc32(y))
                        own.append(y)
                columns = [ids.slice(k, BATCH).take(pa.array(row, pa.int64())), pa.array(number, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(own, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, PIECES + ", ids binary" * with_ids)


Pattern = list[tuple[int, int]]  # (length, how many of it), longest first


def _reach(left: np.ndarray, room: int, without: int) -> int:
    """The largest sum of pieces, none or more, that is no larger than ``room``."""
    bits, mask = 1, (1 << (room + 1)) - 1
    for length in np.flatnonzero(left[1 : room + 1]) + 1:
        length = int(length)
        many = min(int(left[length]) - (length == without), room // length)
        step = 1
        while many > 0:
            take = min(step, many)
            bits |= (bits << (take * length)) & mask
            many -= take
            step *= 2
    return bits.bit_length() - 1


def reduce(counts: np.ndarray) -> tuple[list[tuple[int, Pattern]], np.ndarray]:
    """Rows that some best packing has, with their number, and the counts of what is left.

    ``counts[n]`` is the number of pieces of length n; rows hold ``len(counts) - 1``.
    """
    size, left = len(counts) - 1, counts.astype(np.int64).copy()
    fixed: list[tuple[int, Pattern]] = []

    def fix(many: int, *lengths: int) -> None:
        pattern: dict[int, int] = {}
        for n in lengths:
            pattern[n] = pattern.get(n, 0) + 1
            left[n] -= many
        fixed.append((many, sorted(pattern.items(), reverse=True)))

    if left[size]:
        fix(int(left[size]), size)
    changed = True
    while changed:
        changed = False
        for j in range(size - 1, 0, -1):
            while left[j]:
                room = size - j
                others = left[1 : room + 1].copy()
                if j <= room:
                    others[j - 1] -= 1
                fits = np.flatnonzero(others > 0) + 1
                if not len(fits):
                    if j <= room:  # it fits with itself alone, of which there is none more
                        fix(1, j)
                    else:
                        fix(int(left[j]), j)
                    changed = True
                    continue
                best, least = int(fits[-1]), int(fits[0])
                if best < room:
                    again = least if least != best or others[best - 1] > 1 else (int(fits[1]) if len(fits) > 1 else size)
                    if best + again <= room or _reach(left, room, j) > best:
                        break
                fix(int(left[j]) // 2 if best == j else int(min(left[j], left[best])), j, best)
                changed = True
    return fixed, left


def best_fit(counts: np.ndarray) -> list[tuple[int, Pattern]]:
    """Rows, with their number, of best fit over the pieces from the longest to the shortest."""
    size = len(counts) - 1
    by_room: list[list[tuple[int, Pattern]]] = [[] for _ in range(size + 1)]
    has = np.zeros(size + 1, np.bool_)

    def put(room: int, many: int, pattern: Pattern) -> None:
        if many:
            by_room[room].append((many, pattern))
            has[room] = True

    for n in range(size, 0, -1):
        todo = int(counts[n])
        while todo:
            found = int(np.argmax(has[n:])) + n
            if has[found]:
                many, pattern = by_room[found].pop()
                has[found] = bool(by_room[found])
                room = found
            else:
                many, pattern, room = todo, [], size
            each = room // n
            full, rest = divmod(todo, each)
            full = min(full, many)
            rest = rest if full < many else 0
            put(room - each * n, full, [*pattern, (n, each)])
            if rest:
                put(room - rest * n, 1, [*pattern, (n, rest)])
            if pattern:
                put(room, many - full - bool(rest), pattern)
            todo -= full * each + rest
    return [group for groups in by_room for group in groups]


def plan(counts: np.ndarray) -> list[tuple[int, Pattern]]:
    fixed, left = reduce(counts)
    return fixed + best_fit(left)


def slots(patterns: list[tuple[int, Pattern]], size: int) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that patterns take, in one table sorted by length, rank."""
    taken = np.zeros(size + 1, np.int64)
    rows, first = [], 0
    for many, pattern in patterns:
        at = 0
        for n, each in pattern:
            rows.append((n, int(taken[n]), first, each, at))
            taken[n] += many * each
            at += n * each
        first += many
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "row", "each", "at"), table.T))


def place(rows: DataFrame, size: int = SIZE, bucket: int = BUCKET) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; ``rows`` is read more than once."""
    histogram = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most one row for each length
        histogram[r["length"]] = r["count"]
    table = slots(plan(histogram), size)
    buckets = max(1, -(-int(histogram.sum()) // bucket))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Over.partitionBy("length").orderBy("bucket").rowsBetween(Over.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Over.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("number", F.row_number().over(within)).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("number") - 1)
    names = rows.columns

    def run(batches):
        keys = table["length"] << 44 | table["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, length << 44 | rank, "right") - 1
            row, number = np.divmod(rank - table["rank"][k], table["each"][k])
            out = [batch.column(c) for c in names] + [pa.array(table["row"][k] + row), pa.array(table["at"][k] + number * length)]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.select(*names, "rank").mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False, task_words: int | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset`` for each piece."""
    return place(scratch.save(pieces(docs, path, size, end, with_ids, task_words), "pieces"), size)
