"""Removal of word windows that documents with a smaller id also hold, found by recompression.

1. Each text is recompressed (``recompression``): rounds name runs and pairs of its words' names.
   Every window gets the key of a high-level symbol that is the same at all occurrences of the
   window.  The distinct keys of a text, about one for 15 words, are all that leaves this pass.
2. Symbols held by different texts reveal repeats; they are found with one aggregation.  Only
   texts that hold some go on, and of equal texts only the one with the smallest id.
3. Windows at shared symbols are hashed to 128 bits; the first holder (smallest id) is found for
   each hash that more than one document has.
4. Windows that a smaller id holds are joined to passages, and each passage is written in symbols
   on both sides (``spell``).  Equal symbols mean equal words if no name has two meanings, which
   is checked on the global dictionary of all rounds' names that the passages use: names with what
   they are made of, down to the words' bytes, aggregated over all executors.
5. A passage whose symbols differ, or a name with two meanings, is a collision of hashes: all is
   done again with another seed.  So a word goes only where the words are truly the same.
6. The covered words are removed from their texts.

Names are hashes of what they name, so they are global without an exchange of all symbols for each
round; the exchange is that of the dictionary.

Results for odd input: a null text has no words; a row with a null ``doc_id`` keeps all its words
and owns no window; rows with equal ``doc_id`` do not remove each other's words; repeated rows
give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import recompression as R
from quillspark.llm import scratch
from quillspark.llm import words as W

WINDOW = 50
_UP3 = np.uint64(0x1D8E4E27C47D124F)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The words of each text joined by one space, one text after the other, and its offsets."""
    size = ends - starts
    follows = np.ones(len(starts), np.bool_)
    follows[first[:-1][np.diff(first) > 0]] = False
    size = size + follows
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(at[-1]), 32, np.uint8)
    place = np.ones(len(out), np.bool_)
    place[at[:-1][follows]] = False
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    out[place] = data[np.cumsum(edge[:-1], dtype=np.int8).astype(np.bool_)]
    return memoryview(out), at[first]


def _profile(window: int, seed: int):
    def run(batches):
        for batch in batches:
            ids, tids = batch.column("doc_id"), batch.column("tid")
            for a, b, data, offsets in W.slices(batch.column("text")):
                starts, ends, first = W.spans(data, offsets)
                key = R.anchors(W.names(data, starts, ends, seed), first, window)
                at = np.flatnonzero(key)
                text = np.searchsorted(first, at, "right") - 1
                new = np.ones(len(at), np.bool_)
                new[1:] = (key[at[1:]] != key[at[:-1]]) | (text[1:] != text[:-1])
                text, found = text[new], key[at[new]].view(np.int64)
                whole, cuts = joined(data, starts, ends, first)
                sha = [hashlib.sha256(whole[i:j]).digest() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                places = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), tids.slice(a, b - a), pa.array(sha, pa.binary()), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(places), pa.array(found))],
                    ["doc_id", "tid", "sha", "n_words", "keys"],
                )

    return run


def _own_keys(batch, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column of rows a to b, and the row of each."""
    column = batch.slice(a, b - a) if isinstance(batch, pa.ListArray) else batch
    many = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(b - a), many)


def _windows(window: int, seed: int):
    """Rows for the windows at shared keys: two hashes, the document, the first place."""

    def run(batches):
        for batch in batches:
            ids, tids = batch.column("doc_id"), batch.column("tid")
            for a, b, data, offsets in W.slices(batch.column("text")):
                starts, ends, first = W.spans(data, offsets)
                name = W.names(data, starts, ends, seed)
                key = R.anchors(name, first, window)
                at = np.flatnonzero(key)
                text = np.searchsorted(first, at, "right") - 1
                shared, row = _own_keys(batch.column("keys"), a, b)
                salt = W.mix(np.arange(b - a, dtype=np.uint64) + _UP3)
                at = at[np.isin(key[at] ^ salt[text], shared.view(np.uint64) ^ salt[row])]
                text = np.searchsorted(first, at, "right") - 1
                one = R.span_hash(R.prefix_sums(name, R._UP2), at, at + window)
                two = R.span_hash(R.prefix_sums(name, _UP3), at, at + window)
                _, keep = np.unique(one ^ salt[text], return_index=True)
                keep.sort()
                text = text[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[keep].view(np.int64)), pa.array(two[keep].view(np.int64)), ids.slice(a, b - a).take(pa.array(text)), tids.slice(a, b - a).take(pa.array(text)), pa.array((at[keep] - first[text]).astype(np.int32))],
                    ["one", "two", "doc_id", "tid", "place"],
                )

    return run


_SPELLING = "kind string, owner bigint, otid bigint, oplace int, size int, symbols array<bigint>, name bigint, a bigint, b bigint, word binary"
KNOWN = 1 << 20


def _numbers(column: pa.Array, *fields: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Fields of a list of structs, and the row of each struct."""
    flat = column.flatten()
    many = np.diff(column.offsets.to_numpy())
    return [flat.field(f).to_numpy(zero_copy_only=False) for f in fields], np.repeat(np.arange(len(column)), many)


def passages(row: np.ndarray, place: np.ndarray, owner: np.ndarray, otid: np.ndarray, oplace: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first hit, number of hits) of runs of windows that follow each other on both sides."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(row), np.bool_)
    new[1:] = (np.diff(row) != 0) | (np.diff(place) != 1) | (np.diff(oplace) != 1) | (np.diff(owner) != 0) | (np.diff(otid) != 0)
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(row)))


def _hits(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, place, owner, otid and oplace of all windows to go, in text order."""
    (place, owner, otid, oplace), row = _numbers(column, "place", "owner", "otid", "oplace")
    turn = np.lexsort((place, row))
    return tuple(x[turn] for x in (row, place, owner, otid, oplace))


def _spelt(data, starts, ends, first, start, end, key, seed, known):
    """Rows for passages of words [start, end): their symbols, and the names not told of yet."""
    name = W.names(data, starts, ends, seed)
    rounds = R.named_rounds(name, first)
    symbols, own = R.spell(name, first, start, end, rounds)
    places = np.searchsorted(own, np.arange(len(start) + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(places), pa.array(symbols.view(np.int64)))
    columns = [pa.array(x) for x in key]
    kinds = pa.array(["passage"] * len(start), pa.string())
    yield pa.RecordBatch.from_arrays([kinds, *columns, lists, *_none(len(start), 3), pa.nulls(len(start), pa.binary())], _FIELDS)
    words = np.flatnonzero(R.within(np.arange(len(name)), np.arange(len(name)) + 1, start, end))
    found = [(R.WORD, name[words], words.astype(np.uint64), np.zeros(len(words), np.uint64))]
    for r in itertools.chain.from_iterable(rounds):
        where, kind, a, b = r.made
        use = R.within(r.low[where], r.high[where], start, end)
        found.append((kind, r.name[where][use], a[use], b[use]))
    for kind, names, a, b in found:
        _, once = np.unique(names, return_index=True)
        names, a, b = names[once], a[once], b[once]
        if len(known[kind]):
            at = np.minimum(np.searchsorted(known[kind], names), len(known[kind]) - 1)
            new = known[kind][at] != names
            names, a, b = names[new], a[new], b[new]
        if not len(names):
            continue
        known[kind] = np.union1d(known[kind], names) if len(known[kind]) < KNOWN else names
        n, word = len(names), pa.nulls(len(names), pa.binary())
        if kind == R.WORD:
            at = a.astype(np.int64)
            word, a, b = pa.array([data[i:j].tobytes() for i, j in zip(starts[at].tolist(), ends[at].tolist())], pa.binary()), b, b
        told = pa.array([("word", "run", "pair")[kind]] * n, pa.string())
        nothing = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([told, *nothing, *(pa.array(x.view(np.int64)) for x in (names, a, b)), word], _FIELDS)


_FIELDS = ["kind", "owner", "otid", "oplace", "size", "symbols", "name", "a", "b", "word"]


def _none(n: int, many: int) -> list[pa.Array]:
    return [pa.nulls(n, pa.int64())] * many


def _spell_lost(window: int, seed: int):
    """The passages of texts that lose words, each under its place with the owner."""

    def run(batches):
        known = [np.zeros(0, np.uint64)] * 3
        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column("text")):
                starts, ends, first = W.spans(data, offsets)
                row, place, owner, otid, oplace = _hits(batch.column("hits").slice(a, b - a))
                at, many = passages(row, place, owner, otid, oplace)
                start, size = first[row[at]] + place[at], (many + window - 1).astype(np.int32)
                yield from _spelt(data, starts, ends, first, start, start + size, (owner[at], otid[at], oplace[at], size), seed, known)

    return run


def _spell_owned(seed: int):
    """The same places of the owners' texts."""

    def run(batches):
        known = [np.zeros(0, np.uint64)] * 3
        for batch in batches:
            ids, tids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tid"))
            for a, b, data, offsets in W.slices(batch.column("text")):
                starts, ends, first = W.spans(data, offsets)
                (place, size), row = _numbers(batch.column("asked").slice(a, b - a), "oplace", "size")
                start = first[row] + place
                yield from _spelt(data, starts, ends, first, start, start + size, (ids[a:b][row], tids[a:b][row], place, size), seed, known)

    return run


def _cut(window: int, seed: int):
    """Rows for the texts that lose words: how many, and what is left."""

    def run(batches):
        for batch in batches:
            ids, tids = batch.column("doc_id"), batch.column("tid")
            for a, b, data, offsets in W.slices(batch.column("text")):
                starts, ends, first = W.spans(data, offsets)
                name = W.names(data, starts, ends, seed)
                at = np.flatnonzero(R.window_starts(first, window))
                text = np.searchsorted(first, at, "right") - 1
                sums = R.prefix_sums(name, R._UP2)
                salt = W.mix(np.arange(b - a, dtype=np.uint64) + _UP3)
                (places,), row = _numbers(batch.column("hits").slice(a, b - a), "place")
                gone = first[row] + places
                held = R.span_hash(sums, gone, gone + window) ^ salt[row]
                turn = np.argsort(held, kind="stable")
                gone, held = gone[turn], held[turn]
                own = R.span_hash(sums, at, at + window) ^ salt[text]
                k = np.minimum(np.searchsorted(held, own), max(len(held) - 1, 0))
                same = held[k] == own if len(held) else np.zeros(len(own), np.bool_)
                at, model = at[same], gone[k[same]] if len(held) else at[:0]
                for d in range(window):  # a window that comes again in its text must have the same words
                    same = name[at + d] == name[model + d]
                    at, model = at[same], model[same]
                cover = np.zeros(len(name) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(keep)])[first]
                whole, cuts = joined(data, starts[keep], ends[keep], left)
                texts = [str(whole[i:j], "utf-8") for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), tids.slice(a, b - a), pa.array((np.diff(first) - np.diff(left)).astype(np.int64)), pa.array(texts, pa.string())],
                    ["doc_id", "tid", "n_removed", "kept"],
                )

    return run


def _collided(lost: DataFrame, suspects: DataFrame, window: int, seed: int) -> bool:
    """Whether a passage differs from its owner's, or a name in use has two meanings."""
    own = scratch.save(lost.select("text", "hits").mapInArrow(_spell_lost(window, seed), _SPELLING), "spelt-lost")
    place = ["owner", "otid", "oplace", "size"]
    asked = own.where("kind = 'passage'").select(*place).distinct().groupBy("owner", "otid").agg(F.collect_list(F.struct("oplace", "size")).alias("asked"))
    held = suspects.join(asked, (F.col("doc_id") == F.col("owner")) & (F.col("tid") == F.col("otid"))).select("doc_id", "tid", "text", "asked").dropDuplicates(["doc_id", "tid"])
    other = scratch.save(held.mapInArrow(_spell_owned(seed), _SPELLING), "spelt-owned")
    mine = own.where("kind = 'passage'").select(*place, "symbols").distinct()
    differ = mine.join(other.where("kind = 'passage'").select(*place, F.col("symbols").alias("theirs")), place, "left").where(~F.col("symbols").eqNullSafe(F.col("theirs")))
    names = own.unionByName(other).where("kind != 'passage'").groupBy("name")
    meaning = ["kind", "a", "b", "word"]
    twice = names.agg(*(f(c).alias(f"{tag}_{c}") for c in meaning for f, tag in ((F.min, "low"), (F.max, "high")))).where(" or ".join(f"low_{c} < high_{c}" for c in meaning))
    return not (differ.isEmpty() and twice.isEmpty())


def cuts(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): a row with ``doc_id, tid, sha, n_words, owner`` for each row of ``docs``, and
    one with ``doc_id, tid, n_removed, kept`` for each text that loses some of its words.

    ``tid`` (a hash of the text) tells rows of one ``doc_id`` apart; ``sha`` is the SHA-256 of the
    words joined by spaces.  A row whose ``owner`` is smaller than its ``doc_id`` repeats all the
    words of that document.
    """
    return next(found for seed in itertools.count() if (found := _seeded(docs, window, seed)))


def _seeded(docs: DataFrame, window: int, seed: int) -> tuple[DataFrame, DataFrame] | None:
    texts = keyed(docs).select("doc_id", "tid", "text")
    profile = scratch.save(texts.mapInArrow(_profile(window, seed), "doc_id bigint, tid bigint, sha binary, n_words bigint, keys array<bigint>"), "profile")
    named = profile.where("doc_id is not null")
    owners = named.groupBy("sha").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    owners = scratch.save(owners, "owners")
    rows = profile.drop("keys").join(owners, "sha", "left").withColumn("owner", F.coalesce("owner", "doc_id"))
    held = named.select("doc_id", "tid", F.xxhash64("sha").alias("kind"), F.explode("keys").alias("key"))
    # different texts must share a key; copies of one text do not count
    shared = held.groupBy("key").agg(F.min("kind").alias("low"), F.max("kind").alias("high")).where("low < high").select("key")
    shared = scratch.save(shared, "shared")
    owned = rows.where("doc_id = owner").select("doc_id", "tid").distinct()
    wanted = held.join(shared, "key").groupBy("doc_id", "tid").agg(F.collect_set("key").alias("keys")).join(owned, ["doc_id", "tid"], "left_semi")
    suspects = scratch.save(texts.join(wanted, ["doc_id", "tid"]), "suspects")
    seen = suspects.mapInArrow(_windows(window, seed), "one bigint, two bigint, doc_id bigint, tid bigint, place int")
    holder = F.struct(F.col("doc_id").alias("owner"), F.col("tid").alias("otid"), F.col("place").alias("oplace"))
    first = seen.groupBy("one", "two").agg(F.min(holder).alias("holder"), F.max("doc_id").alias("most")).where("holder.owner < most").select("one", "two", "holder.*")
    first = scratch.save(first, "first")
    hit = F.struct("place", "owner", "otid", "oplace")
    gone = seen.join(first, ["one", "two"]).where("doc_id > owner").groupBy("doc_id", "tid").agg(F.collect_set(hit).alias("hits"))
    lost = scratch.save(suspects.select("doc_id", "tid", "text").join(gone, ["doc_id", "tid"]).dropDuplicates(["doc_id", "tid"]), "lost")
    if _collided(lost, suspects, window, seed):
        return None
    return rows, lost.mapInArrow(_cut(window, seed), "doc_id bigint, tid bigint, n_removed bigint, kept string")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))


def _copy(window: int):
    """Whether all words of a row go because the text of a smaller id is the same."""
    return F.coalesce((F.col("owner") < F.col("doc_id")) & (F.col("n_words") >= window), F.lit(False))


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs``."""
    rows, cut = cuts(docs, window)
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("tid").alias("cut_tid"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return rows.join(cut, (rows.doc_id == cut.cut_id) & (rows.tid == cut.cut_tid), "left").select(
        "doc_id",
        "n_words",
        F.when(_copy(window), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(_copy(window), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with its columns, repeated words removed from ``text``.

    A text that loses nothing stays as it was; one that loses words becomes the words that are
    left, joined by one space (empty if none is left).
    """
    rows, cut = cuts(docs, window)
    mine, own, kept = scratch.fresh(docs, "cut_id", "cut_tid", "cut_text")
    copies = rows.where(_copy(window)).select("doc_id", "tid", F.lit("").alias("kept")).distinct()
    changed = copies.unionByName(cut.select("doc_id", "tid", "kept")).toDF(mine, own, kept)
    tid = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    out = docs.join(changed, (docs["doc_id"] == F.col(mine)) & (tid == F.col(own)), "left")
    return out.select(*(F.coalesce(kept, docs["text"]).alias(c) if c == "text" else docs[c] for c in docs.columns))
