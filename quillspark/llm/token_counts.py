"""Token counts of fields and sections from one encoding of the whole document.

A document is encoded once.  The byte lengths of its tokens give each token's span; the span is
joined with the document's sections, which are intervals of it.  A token within one section
counts there.  A token that crosses a boundary is allocated by ``rule``:

``start``     to the section that holds its first byte;
``majority``  to the section that holds most of its bytes, the earlier one on a tie;
``split``     to each section by its share of the token's bytes (counts are then fractions).

Sections are the lines of a text with their line feeds, or, with ``fields``, columns that are
joined by line feeds (a column's line feed belongs to it).

Results for odd input: a null text or field is empty; an empty text has one empty section with no
tokens; null ids and repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "majority", "split")
# The public pre-tokenizer pattern of the vocabulary; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS = 256
# Unicode white space, as the pattern's \\s has it; fixed value.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = 1024


class Encoder:
    """Token ids of a text and the byte length of each token."""

    def __init__(self, path: str, run: int = RUN):
        import tiktoken

        self.run = re.compile(f"[{SPACE}]{{{run},}}")

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def lengths(self, text: str) -> np.ndarray:
        return self.length[np.array(self.ids(text), np.int64)]

    def ids(self, text: str) -> list[int]:
        """The vocabulary's ids.  The pattern makes a run of white space one piece, but for its last
        character where a word follows; long runs, which would exhaust the matcher, are cut so here."""
        out, at = [], 0
        for m in self.run.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:] if at else text)


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _kept:
        _kept.clear()
        _kept[path] = Encoder(path)
    return _kept[path]


def allocate(lengths: np.ndarray, bounds: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; ``bounds`` has the sections' first bytes and the
    document's end.  A crossing token is told of in the section that holds its first byte."""
    end = np.cumsum(lengths)
    start = end - lengths
    sections = len(bounds) - 1
    # the last section that starts at or before a byte; empty sections hold none
    first = np.searchsorted(bounds[:-1], start, "right") - 1
    last = np.searchsorted(bounds[:-1], end - 1, "right") - 1
    crosses = np.bincount(first[first != last], minlength=sections)
    if rule == "start":
        return np.bincount(first, minlength=sections), crosses
    within = first == last
    count = np.bincount(first[within], minlength=sections).astype(np.float64 if rule == "split" else np.int64)
    for t in np.flatnonzero(~within).tolist():
        own = np.arange(first[t], last[t] + 1)
        part = np.minimum(bounds[own + 1], end[t]) - np.maximum(bounds[own], start[t])
        if rule == "split":
            count[own] += part / lengths[t]
        else:
            count[own[part.argmax()]] += 1
    return count, crosses


def line_bounds(data: bytes) -> np.ndarray:
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate([[0], cuts[cuts < len(data)], [len(data)]])


def by_section(docs: DataFrame, path: str, fields: list[str] | None = None, rule: str = "start") -> DataFrame:
    """``doc_id, section, start, length, n_tokens, n_crossing``: a row for each section of each
    document; ``start`` and ``length`` are bytes of the UTF-8 form."""
    if rule not in RULES:
        raise ValueError(f"rule is none of {RULES}")
    count = pa.float64() if rule == "split" else pa.int64()

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                rows, sections, starts, sizes, tokens, crossing = ([] for _ in range(6))
                columns = [part.column(k).to_pylist() for k in range(1, part.num_columns)]
                for i, values in enumerate(zip(*columns)):
                    if fields is None:
                        text = values[0]
                        bounds = line_bounds(text.encode())
                    else:
                        text = "\n".join(values)
                        bounds = np.concatenate([[0], np.cumsum([len(v.encode()) + 1 for v in values])])
                        bounds[-1] -= 1
                    own, cross = allocate(encode.lengths(text), bounds, rule)
                    n = len(bounds) - 1
                    rows.append(np.full(n, i))
                    sections.append(np.arange(n, dtype=np.int32))
                    starts.append(bounds[:-1])
                    sizes.append(np.diff(bounds))
                    tokens.append(own)
                    crossing.append(cross)
                found = [np.concatenate(x) for x in (rows, sections, starts, sizes, tokens, crossing)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(found[0])), pa.array(found[1]), *(pa.array(x.astype(np.int64)) for x in found[2:4]), pa.array(found[4], count), pa.array(found[5].astype(np.int64))],
                    ["doc_id", "section", "start", "length", "n_tokens", "n_crossing"],
                )

    wanted = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"f{k}") for k, c in enumerate(fields or ["text"])]
    kind = "double" if rule == "split" else "bigint"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *wanted).mapInArrow(run, f"doc_id bigint, section int, start bigint, length bigint, n_tokens {kind}, n_crossing bigint")
