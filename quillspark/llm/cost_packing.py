"""Packing of token sequences so that their attention costs are balanced.

A piece of n tokens costs ``linear * n + quadratic * n * n``: the layers that look at one token, and
attention within the piece.  Documents are cut where a full sequence ends; the rests are taken from
the longest to the shortest, and each goes to the sequence of the lowest cost so far that has room
for it.  One that fits nowhere is cut: its head fills the sequence with the most room, the rest is
taken again in its turn.  So every sequence is filled to its last token.

Each task packs its documents in windows (``window`` documents or ``tokens`` ids, whichever comes
first) and hands what is less than a sequence on to its next window, so that nothing is shuffled
and memory is bounded.  What a task has left at its end goes to sequences of powers of two, which
need no padding.  The lowest cost is therefore the lowest among a window's sequences.

Results for odd input: a null or empty text is the end token alone; rows with a null ``doc_id`` and
repeated rows are packed each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import token_counts

SIZE = 1024
END = 0
LINEAR, QUADRATIC = 6 * 1024, 1  # a token's work in layers of width 1024, beside that of a pair of tokens
WINDOW, TOKENS = 4096, 1 << 22
TASK = 40  # bits of a sequence's number below the task's
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder(token_counts.Encoder):
    """Ids of a byte-level BPE file; ``special`` strings in a text are their ids, as that file has it."""

    def __init__(self, path: str, run: int = token_counts.RUN):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(signs[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("ranks", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.run = re.compile(f"[{token_counts.SPACE}]{{{run},}}")
        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return super().ids(text)


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = Encoder(path)
    return _kept[path]


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def balance(lengths: list[int], size: int, last: bool, linear: int = LINEAR, quadratic: int = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """((item, start, length, sequence, offset) of the pieces, (item, start, length) left over, sequences).

    Less than ``size`` tokens are left over; none if ``last``.
    """
    total, placed, tails = sum(lengths), [], [[] for _ in range(size + 1)]
    made = 0
    for item, n in enumerate(lengths):
        for start in range(0, n - size + 1, size):
            placed.append((item, start, size, made, 0))
            made += 1
        if n % size:
            tails[n % size].append((item, n - n % size))
    room = [size] * (total // size - made) + (powers(total % size) if last else [])
    full, cost = list(room), [0] * len(room)
    waiting: list[list[int]] = [[] for _ in range(size + 1)]  # sequences by the room they have
    for s, r in enumerate(room):
        waiting[r].append(s)
    fits = [(0, s) for s in waiting[size]]  # those with room for the piece in turn, by cost
    waiting[size] = []
    left = []

    def put(s: int, item: int, start: int, n: int) -> None:
        placed.append((item, start, n, made + s, full[s] - room[s]))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n in range(size - 1, 0, -1):
        for s in waiting[n]:
            heapq.heappush(fits, (cost[s], s))
        waiting[n] = []
        for item, start in tails[n]:
            if fits:
                s = heapq.heappop(fits)[1]
                put(s, item, start, n)
                if room[s] >= n:
                    heapq.heappush(fits, (cost[s], s))
                else:
                    waiting[room[s]].append(s)
                continue
            most = next((r for r in range(n - 1, 0, -1) if waiting[r]), 0)
            if most:
                put(waiting[most].pop(), item, start, most)
                tails[n - most].append((item, start + most))
            else:
                left.append((item, start, n))
    return placed, left, made + len(room)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, linear: int = LINEAR, quadratic: int = QUADRATIC, window: int = WINDOW, tokens: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, if asked for, ``ids`` (unsigned little-endian).  ``path`` is a byte-level BPE file."""

    def run(batches):
        encode = encoder(path).ids
        first = TaskContext.get().partitionId() << TASK
        held: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids from there, the document's tokens
        count = 0

        def flush(last: bool):
            nonlocal held, first, count
            placed, left, made = balance([len(h[2]) for h in held], size, last, linear, quadratic)
            rows = []
            for item, start, n, sequence, offset in placed:
                doc, at, ids, of = held[item]
                own = ids[start : start + n].tobytes()
                rows.append((doc, at + start, n, zlib.crc32(own), of, first + sequence, offset, own)[: 7 + with_ids])
            held = [(held[item][0], held[item][1] + start, held[item][2][start : start + n].copy(), held[item][3]) for item, start, n in left]
            first, count = first + made, sum(n for _, _, n in left)
            columns = list(zip(*rows)) if rows else [()] * (7 + with_ids)
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                held.append((doc, 0, ids, len(ids)))
                count += len(ids)
                if len(held) >= window or count >= tokens:
                    yield flush(False)
        yield flush(True)

    kind = PIECES + ", ids binary" * with_ids
    names = [c.split()[0] for c in kind.split(", ")]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)
