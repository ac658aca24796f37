"""SentencePiece encoding and decoding by a weighted transducer and its tropical shortest path.

The transducer is compiled from a model file: the normaliser (spaces become the meta symbol, one
is put in front), an arc for each piece, and byte arcs for characters that no piece has.  Byte-pair
models merge by rank, which a sum of piece scores does not express; what they do satisfy is that a
segmentation is the model's own exactly if each two neighbouring pieces are: encoded together they
come out as those two.  So the states are pieces, and an arc from a piece to the next weighs zero
where the pair is *settled* and infinity otherwise.  Composed with an input, one path of finite
weight remains; the shortest-path recursion keeps, for each place, the one piece that ends there.

A text is composed part by part: between two characters that are neighbours in no piece, every
path has a boundary, so parts are independent and equal parts share one result.

For unigram models arcs weigh minus their score, and the recursion is the usual one.

Results for odd input: a null or empty text has no pieces; null ids and repeated rows are kept;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
CACHE_PARTS = 250_000
ROWS = 64
SHORT = 32


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        normal = model.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("only the identity normaliser is compiled")
        self.prefix, self.bpe = normal.add_dummy_prefix, model.trainer_spec.model_type == 2
        self.piece = [p.piece for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        self.id = {p.piece: k for k, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.byte = [0] * 256
        for k, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[1:-1], 16)] = k
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.fallback = model.trainer_spec.byte_fallback
        self.longest = max(map(len, self.id))
        self.raw = [self._bytes(k, p.type) for k, p in enumerate(model.pieces)]
        inside = {a + b for p in self.id for a, b in zip(p, p[1:])}
        self.inside = inside
        self.settled: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.word: dict[str, bytes] = {}
        self.older_word: dict[str, bytes] = {}

    def _bytes(self, k: int, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(self.piece[k][1:-1], 16)])
        return self.piece[k].replace(META, " ").encode() if kind in (NORMAL, USER) else b""

    # --- byte-pair models

    def merges(self, text: str) -> list[str]:
        """Merges neighbours by score, the leftmost first among equals: the model's definition."""
        return self._scan(text) if len(text) <= SHORT else self._queue(text)

    def _scan(self, text: str) -> list[str]:
        """Looks through all neighbours for each merge, which is fastest for a few characters."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _queue(self, text: str) -> list[str]:
        """Keeps possible merges in a queue, so that time grows with the length."""
        parts, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                piece = parts[k] + parts[after[k]]
                i = self.id.get(piece)
                if i is not None:
                    heapq.heappush(heap, (-self.score[i], k, piece))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, piece = heapq.heappop(heap)
            follows = after[k]
            if parts[k] and follows < n and len(parts[k]) + len(parts[follows]) == len(piece):  # neither has changed
                parts[k], parts[follows] = piece, ""
                after[k] = after[follows]
                if after[k] < n:
                    before[after[k]] = k
                offer(before[k])
                offer(k)
        return [p for p in parts if p]

    def _settled(self, a: str, b: str) -> bool:
        found = self.settled.get((a, b))
        if found is None:
            if len(self.settled) > 2_000_000:
                self.settled.clear()
            found = self.settled[a, b] = self.merges(a + b) == [a, b]
        return found

    def _path_bpe(self, text: str) -> list[str]:
        """The path of weight zero; the pieces are found from the end."""
        n = len(text)
        last: list[str | None] = [""] * (n + 1)
        known, longest = self.id, self.longest
        for end in range(1, n + 1):
            found = None
            for start in range(max(0, end - longest), end):
                piece = text[start:end]
                if piece in known or end - start == 1:
                    before = last[start]
                    if (self.whole(piece) if start == 0 else before and self._settled(before, piece)):
                        found = piece
                        break
            last[end] = found
        out, at = [], n
        while at:
            piece = last[at]
            if piece is None:  # equal scores can break the pairwise rule; merge as defined
                return self.merges(text)
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def whole(self, piece: str) -> bool:
        """Whether a piece alone is encoded as itself."""
        return len(piece) == 1 or self._settled_alone(piece)

    def _settled_alone(self, piece: str) -> bool:
        found = self.settled.get((piece, ""))
        if found is None:
            found = self.settled[piece, ""] = self.merges(piece) == [piece]
        return found

    # --- unigram models

    def _path_unigram(self, text: str) -> list[str]:
        n = len(text)
        cost = [0.0] + [float("inf")] * n
        back = [0] * (n + 1)
        poor = -min(self.score) + 10
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                i = self.id.get(text[start:end])
                weight = -self.score[i] if i is not None else poor if end - start == 1 else None
                if weight is not None and cost[start] + weight < cost[end]:
                    cost[end], back[end] = cost[start] + weight, start
        out, at = [], n
        while at:
            out.append(text[back[at] : at])
            at = back[at]
        return out[::-1]

    # --- texts

    def _ids(self, pieces: list[str]) -> bytes:
        out = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.older.get(part)
            if found is None:
                found = self._ids(self._path_bpe(part) if self.bpe and META * 2 not in part else self.merges(part) if self.bpe else self._path_unigram(part))
            self.parts[part] = found
            if len(self.parts) > CACHE_PARTS:
                self.older, self.parts = self.parts, {}
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a run of characters, cut where no piece has both neighbours."""
        cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.inside), len(word)]
        return b"".join(self._part(word[a:b]) for a, b in zip(cuts, cuts[1:]))

    def encode(self, text: str) -> bytes:
        """Unsigned little-endian 32-bit ids."""
        if not text:
            return b""
        text = text.replace(" ", META)
        if self.prefix:
            text = META + text
        out, cache = [], self.word
        for word in _WORD.findall(text):
            found = cache.get(word)
            if found is None:
                found = self.older_word.get(word)
                if found is None:
                    found = self._word(word)
                if len(word) <= 40:
                    cache[word] = found
                if len(cache) > CACHE_PARTS:
                    self.older_word, self.word = cache, {}
                    cache = self.word
            out.append(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_WORD = re.compile(META + "*+[^" + META + "]+|" + META + "+")
_kept: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _kept:
        _kept.clear()
        _kept[path] = Transducer(path)
    return _kept[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: unsigned little-endian 32-bit piece ids of each text."""

    def run(batches):
        t = transducer(path)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t.encode(x or "") for x in part.column("text").to_pylist()], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from rows of ``encode``."""

    def run(batches):
        t = transducer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256`` of each text."""

    def run(batches):
        t = transducer(path)
        low, high = min(t.byte), max(t.byte)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            values = [np.frombuffer(x, "<u4") for x in ids]
            columns = [[len(v) for v in values], [int(((v >= low) & (v <= high)).sum()) for v in values], [zlib.crc32(x) for x in ids]]
            shas = [hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(shas, pa.string())], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256"])

    return encode(docs, path).mapInArrow(run, "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, decoded_sha256 string")
