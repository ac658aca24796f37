"""Quality score of whole texts by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks of ``WIDTH`` bytes, one each ``STRIDE``.
Each byte is a symbol: its value, with two marks that say whether its word repeats one of the two
words before it and whether it ends a run of three words that the text had before.  Symbols are embedded, learned
filters see each chunk, each filter's largest answer over the whole text is kept, and a logistic
unit combines those into one probability.

Training reads a bounded sample: the rows of either label with the smallest hashes of their ids,
``SAMPLE`` at most for each label, of at most ``LONGEST`` bytes each.  It is deterministic.

Results for odd input: a null text scores as an empty one, which is a chunk of padding; repeated
rows score alike; columns other than ``text`` do not count; without labelled rows of both kinds
the score is the share of label 1 among the labelled rows (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm import words as W

WIDTH, STRIDE = 32, 16
PAD, MARKS = 256, 4
SYMBOLS = 257 * MARKS
DIM, FILTERS = 8, 32
SAMPLE, LONGEST = 1000, 1 << 15
EPOCHS, STEPS, BATCH, RATE, SEED = 8, 320, 32, 0.004, 11
BLOCK = 4096


def symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte plus 257 times its marks, for each byte of the texts."""
    out = data.astype(np.int16)
    starts, ends, first = W.spans(data, offsets)
    n = len(starts)
    if n < 2:
        return out
    name = W.names(data, starts, ends)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mark = np.zeros(n, np.int16)
    for back in (1, 2):
        mark[back:] |= (name[back:] == name[:-back]) & (text[back:] == text[:-back])
    if n > 2:
        run = W.mix(name[2:] + W.mix(name[1:-1] + W.mix(name[:-2] + W.mix(text[2:].astype(np.uint64)))))
        run[text[2:] != text[:-2]] = 0
        order = np.argsort(run, kind="stable")
        again = np.zeros(len(run), np.bool_)
        again[order[1:]] = (run[order[1:]] == run[order[:-1]]) & (run[order[1:]] != 0)
        mark[2:] |= again.astype(np.int16) << 1
    mark *= 257
    step = np.zeros(len(data) + 1, np.int16)
    step[starts] += mark
    step[ends] -= mark
    return out + np.cumsum(step[:-1], dtype=np.int16)


class Chunks:
    """The chunks of some texts: symbols by chunk, and the first chunk of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        many = np.maximum(1, -(-(size - WIDTH) // STRIDE) + 1)
        self.first = np.concatenate([[0], np.cumsum(many)])
        row = np.repeat(np.arange(len(size)), many)
        self.start = offsets[row] + (np.arange(len(row)) - self.first[row]) * STRIDE
        self.end = offsets[row + 1]
        self.symbols = np.concatenate([symbols(data, offsets), np.full(WIDTH, PAD, np.int16)])

    def rows(self, at) -> np.ndarray:
        place = self.start[at][:, None] + np.arange(WIDTH)
        found = self.symbols[np.minimum(place, len(self.symbols) - 1)]
        found[place >= self.end[at][:, None]] = PAD
        return found


class Model:
    def __init__(self, table, filters, bias, weight, shift):
        self.table, self.filters, self.bias, self.weight, self.shift = table, filters, bias, weight, shift

    @classmethod
    def constant(cls, share: float) -> Model:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return cls(np.zeros((SYMBOLS, DIM), np.float32), np.zeros((WIDTH * DIM, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), float(np.log(share / (1 - share))))

    def answers(self, symbols: np.ndarray) -> np.ndarray:
        return np.take(self.table, symbols, axis=0).reshape(len(symbols), -1) @ self.filters

    def pooled(self, chunks: Chunks) -> np.ndarray:
        """Each filter's largest answer in each text, BLOCK chunks at a time."""
        first = chunks.first
        out = np.full((len(first) - 1, FILTERS), -np.inf, np.float32)
        for a in range(0, int(first[-1]), BLOCK):
            b = min(a + BLOCK, int(first[-1]))
            found = self.answers(chunks.rows(slice(a, b)))
            low, high = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "left")
            cuts = np.maximum(first[low:high], a) - a
            out[low:high] = np.maximum(out[low:high], np.maximum.reduceat(found, cuts, axis=0))
        return out + self.bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit = np.maximum(self.pooled(Chunks(data, offsets)), 0).astype(np.float64) @ self.weight.astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> Model:
    """Adam on the log loss; a filter learns from the chunk that gave its largest answer."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model.constant(float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    m = Model((rng.standard_normal((SYMBOLS, DIM)) * 0.3).astype(np.float32), (rng.standard_normal((WIDTH * DIM, FILTERS)) * 0.1).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.standard_normal(FILTERS) * 0.3).astype(np.float32), 0.0)
    m.table.reshape(MARKS, 257, DIM)[1:] = m.table[:257]  # marks start without effect
    chunked = [Chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    shift = np.zeros(1, np.float32)
    shares = [m.table, m.filters, m.bias, m.weight, shift]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in shares]
    step, batches = 0, max(1, len(texts) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // batches))  # small samples are seen more often
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 1e-4
        for batch in np.array_split(rng.permutation(len(texts)), batches):
            seen, best = [], np.zeros((len(batch), FILTERS), np.float32)
            for k, i in enumerate(batch.tolist()):
                rows = chunked[i].rows(slice(None))
                found = m.answers(rows)
                top = found.argmax(0)
                seen.append(rows[top])
                best[k] = found[top, np.arange(FILTERS)]
            best += m.bias
            pooled = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-(pooled @ m.weight + shift[0])))
            wrong = (p - labels[batch]) / len(batch)
            back = wrong[:, None] * m.weight * (best > 0)  # text, filter
            rows = np.stack(seen)  # text, filter, place
            vectors = np.take(m.table, rows, axis=0).reshape(len(batch), FILTERS, -1)
            g_filters = np.einsum("bf,bfk->kf", back, vectors)
            g_vectors = (back[:, :, None] * m.filters.T[None]).reshape(-1, DIM)
            g_table = np.zeros_like(m.table)
            flat = rows.reshape(-1)
            for d in range(DIM):
                g_table[:, d] = np.bincount(flat, g_vectors[:, d], SYMBOLS)
            step += 1
            for own, g, (one, two) in zip(shares, (g_table, g_filters, back.sum(0), wrong @ pooled, np.array([wrong.sum()], np.float32)), moments):
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                own -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    m.shift = float(shift[0])
    return m


def trainable(doc_id: Column) -> Column:
    """Rows whose labels may be learned: two thirds of them, by a checksum of the id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """A model from a bounded sample of the labelled rows that may be learned."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(trainable(F.col("doc_id")) & F.col("label").isin(0, 1))
    known = known.withColumn("hash", F.xxhash64("doc_id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    rows = []
    for label in (0, 1):
        few = known.where(F.col("label") == label).orderBy("hash", "doc_id").limit(2 * sample)
        rows += texts.join(few, "doc_id").orderBy("hash", "doc_id", "text").limit(sample).collect()
    rows.sort(key=lambda r: (r["hash"], r["doc_id"], r["label"], r["text"]))
    return train([r["text"].encode() for r in rows], np.array([r["label"] for r in rows]))


def scorer(model: Model):
    """A column function from a text to its score."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        text = text.fill_null("")
        found = [model.score(data, offsets) for _, _, data, offsets in W.slices(text)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return score


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    ids = F.col("doc_id").cast("bigint")
    scored = docs.select(ids.alias("doc_id"), scorer(fit(docs, labels))(F.col("text").cast("string")).alias("score"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with its columns, whatever their names, without the rows that score below ``least``."""
    (score,) = scratch.fresh(docs, "score")
    scored = docs.withColumn(score, scorer(fit(docs, labels))(docs["text"].cast("string")))
    return scored.where(F.col(score) >= least).drop(score)
