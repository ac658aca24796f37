"""Pairs of strings whose ratio reaches a threshold, found by bounds on the characters that they share.

With a ratio of t or more, two strings of n and m characters share M >= t (n + m) / 2 of them in
order, in at most n + m - 2 M + 1 runs.  Where the ratio is difflib's and the second string has 200
characters or more, each run but one at both starts holds a character that is not popular in it, which
bounds the runs too.  So they share at least M - (q - 1) runs' number of pieces of q characters, with
repeats, and counts of pieces by their hashes differ by no more than the rest.

Strings meet in cells of equal keys and near lengths.  A large cell is dealt into parts, and each part
of one side meets each of the other in a task.  A product of matrices bounds the characters that each two
strings of a part share; right strings whose longest run must have GRAM characters are looked up by such
runs instead.  Counts of pieces are compared for what these let through, then longest common subsequences.
Where only the best of each left string is asked for, pairs are taken by falling bounds, and those that
cannot beat or equal it are left out.  Nothing but plans reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import similarity
from quillspark.sources import shared

EPS = 1e-9
PART, CHARS, BLOCK = 1 << 14, 1 << 23, 1 << 15
RUN, GRAM = 6, 10
LEFTS, RIGHTS, WIDTH, HITS = 512, 4096, 256, 1 << 20


def least_of(q: int) -> float:
    """Below this threshold longer strings need not share more runs of q characters."""
    return 2 * (q - 1) / (2 * q - 1)


def short_of(t: float, q: int) -> int | None:
    """The length from which on two strings that reach t share at least one run of q characters."""
    each = (2 * q - 1) * t / 2 - (q - 1)
    return math.floor((q - 1 + EPS) / (2 * each)) + 1 if t > least_of(q) + 0.01 else None


def band(n: Column, t: float) -> Column:
    """Lengths that a ratio of t allows beside n lie in n's band and the ones next to it."""
    return F.floor(F.log(n.cast("double")) / math.log((2 - t) / t) + EPS).cast("int") if t < 1 else n.cast("int")


def _anchors(codes: np.ndarray) -> int:
    """How many characters difflib does not take for popular; all of a short text."""
    if len(codes) < 200:
        return len(codes)
    many = np.unique(codes, return_counts=True)[1]
    return int(many[many <= len(codes) // 100 + 1].sum())


BINS = 128


def _counts(flat: np.ndarray, n: np.ndarray, q: int, bins: int):
    """How often each text, one after the other in ``flat``, has the pieces of q characters of each bin (by
    a hash), for a part of the texts at a time.  Circular differences of such counts modulo 256 are no larger
    than the true ones."""
    ends, done = np.cumsum(n), 0
    while done < len(n):
        first = int(ends[done] - n[done])
        upto = max(done + 1, int(np.searchsorted(ends, first + (1 << 19), "right")))
        upto = min(upto, done + (1 << 12))
        codes, owner = flat[first : ends[upto - 1]].astype(np.uint64), np.repeat(np.arange(upto - done), n[done:upto])
        size = max(0, len(codes) - q + 1)
        own = codes[:size]
        for d in range(1, q):
            own = own * np.uint64(0x100000001B3) + codes[d : size + d]
        own = (own if q == 1 else (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(bins)
        at = owner[:size] * bins + own.astype(np.int64)
        at = at[owner[:size] == owner[q - 1 :]] if q > 1 else at
        yield np.bincount(at, minlength=(upto - done) * bins).reshape(-1, bins).astype(np.int32)
        done = upto


def _bits(flat: np.ndarray, n: np.ndarray, q: int, bins: int, levels: int) -> np.ndarray:
    """A bit for each of so many pieces of a bin that a text has; texts whose bits differ in some places
    differ by no fewer pieces."""
    some = [np.packbits(np.concatenate([c > k for k in range(levels)], 1), axis=1).view(np.uint64) for c in _counts(flat, n, q, bins)]
    return np.concatenate(some) if some else np.zeros((0, bins * levels // 64), np.uint64)


def _dense(t: float, n: np.ndarray, letters: np.ndarray, left, right, low, high):
    """Pairs ``i, j`` that may share enough characters.

    Counts between a low and a high level of each bin are written as one bit a step, so that products of
    rows are sums of lesser counts; steps, and what lies outside of the levels, are rounded up.
    """
    for c in range(0, len(right), RIGHTS):
        some = np.flatnonzero((high > c) & (low < c + RIGHTS))
        if not len(some):
            continue
        of = letters[right[c : c + RIGHTS]]
        base, top = np.quantile(of, 0.02, axis=0, method="lower"), np.quantile(of, 0.98, axis=0, method="higher")
        step = 1
        while (steps := -(-(top - base) // step)).sum() > WIDTH:
            step += 1
        bins = np.repeat(np.arange(BINS), steps)
        level = base[bins] + step * (np.arange(len(bins)) - np.repeat(np.cumsum(steps) - steps, steps))
        half = (t / 2) * n
        b = np.empty((len(of), len(bins) + 2), np.float32)
        b[:, :-2], b[:, -2], b[:, -1] = of[:, bins] > level, 1, np.maximum(of - top, 0).sum(1) - half[right[c : c + RIGHTS]]
        for d in range(0, len(some), LEFTS):
            own = some[d : d + LEFTS]
            mine = letters[left[own]]
            a = np.empty((len(own), len(bins) + 2), np.float32)
            a[:, :-2], a[:, -2], a[:, -1] = (mine[:, bins] > level) * np.float32(step), np.minimum(mine, base).sum(1) - half[left[own]], 1
            first, last = max(0, int(low[own].min()) - c), min(len(of), int(high[own].max()) - c)
            size = float(n[left[own]].max() + n[right[c : c + RIGHTS]].max())
            x, y = np.divmod(np.flatnonzero((a @ b[first:last].T).ravel() >= -0.01 - 1e-5 * size), last - first)
            place = y + first + c
            near = (place >= low[own[x]]) & (place < high[own[x]])
            yield left[own[x[near]]], right[place[near]]


def _hashes(h: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (h ^ cell.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)


def _sparse(t: float, n: np.ndarray, flat: np.ndarray, cell: np.ndarray, runs: np.ndarray, left, right, low, high):
    """Pairs ``i, j`` that share a run of GRAM characters about where both have it.

    A right string is cut at steps at which any run of ``runs`` of its characters has a piece.
    """
    factor, start = np.uint64(0x9E3779B97F4A7C15), np.cumsum(n) - n
    grid = runs[right] - GRAM + 1
    many = (n[right] - GRAM) // grid + 1
    owner = np.repeat(np.arange(len(right)), many)
    spot = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * grid[owner]
    at, own = start[right[owner]] + spot, np.zeros(len(owner), np.uint64)
    for d in range(GRAM):
        own = own * factor + flat[at + d]
    own = _hashes(own, cell[right[owner]])
    order = np.argsort(own)
    own, owner, spot = own[order], owner[order], spot[order]
    some = np.zeros(1 << 24, np.bool_)
    some[own >> np.uint64(40)] = True
    ends, done, kept = np.cumsum(n[left]), 0, np.zeros(0, np.int64)
    while done < len(left):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 20), "right")))
        part, rows = left[done:upto], np.arange(done, upto)
        codes = np.concatenate([flat[start[k] : start[k] + n[k]] for k in part.tolist()]).astype(np.uint64)
        x, p = np.repeat(rows, n[part]), np.arange(len(codes)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        done = upto
        size = max(0, len(codes) - GRAM + 1)
        mine = np.zeros(size, np.uint64)
        for d in range(GRAM):
            mine = mine * factor + codes[d : size + d]
        mine = _hashes(mine, cell[left[x[:size]]])
        k = np.flatnonzero(some[mine >> np.uint64(40)])
        k = k[p[k] + GRAM <= n[left[x[k]]]]
        first = np.searchsorted(own, mine[k])
        met = np.searchsorted(own, mine[k], "right") - first
        k, first, met = k[met > 0], first[met > 0], met[met > 0]
        sums, e = np.cumsum(met), 0
        while e < len(k):
            f = max(e + 1, int(np.searchsorted(sums, (sums[e - 1] if e else 0) + HITS, "right")))
            each = met[e:f]
            hit = np.repeat(first[e:f] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            i, pi, j, pj = np.repeat(x[k[e:f]], each), np.repeat(p[k[e:f]], each), owner[hit], spot[hit]
            e = f
            near = (j >= low[i]) & (j < high[i])
            i, pi, j, pj = i[near], pi[near], j[near], pj[near]
            ni, nj = n[left[i]], n[right[j]]
            lost = ni + nj - 2 * np.ceil((ni + nj) * (t / 2) - EPS).astype(np.int64)
            near = np.abs(pi - pj) + np.abs((ni - pi) - (nj - pj)) <= lost
            pair = np.unique(i[near] * len(right) + j[near])
            if not len(pair):
                continue
            if len(kept):  # of the left string that goes on from the hits before
                pair = pair[~np.isin(pair, kept)]
            if not len(pair):
                continue
            last = pair[-1] // len(right)
            kept = np.concatenate([kept[kept // len(right) == last], pair[pair // len(right) == last]])
            yield left[pair // len(right)], right[pair % len(right)]


def _met(t: float, keys: list[str], difflib: bool, best: bool = False):
    """Reads rows sorted by cell and yields the pairs of both sides whose common subsequence is long enough;
    with ``best`` those of the best ratio of each left string, with it."""
    kinds = [(q, bins) for q, bins in ((2, 256), (3, 1024)) if short_of(t, q) is not None] + [(RUN, 256)] * difflib

    def near(rows: pa.Table):
        cell, side, n = (rows[c].to_numpy() for c in ("cell", "side", "n"))
        new = np.ones(len(cell), np.bool_)
        new[1:] = cell[1:] != cell[:-1]
        cells = np.cumsum(new)
        place = (cells << 32) + n
        lefts, rights = (of[np.argsort(place[of], kind="stable")] for of in (np.flatnonzero(side == 0), np.flatnonzero(side == 1)))

        def windows(right: np.ndarray):
            """Left strings, and from where to where in ``right`` lengths are near theirs."""
            start = place[lefts] - n[lefts]
            low = np.searchsorted(place[right], start + np.ceil(n[lefts] * (t / (2 - t)) - EPS).astype(np.int64))
            high = np.searchsorted(place[right], start + np.floor(n[lefts] * ((2 - t) / t) + EPS).astype(np.int64), "right")
            return lefts[high > low], right, low[high > low], high[high > low]

        if not len(windows(rights)[0]):
            return
        text = rows["text"].to_pylist()
        flat = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(n) - n
        letters = np.concatenate([*_counts(flat, n, 1, BINS)])
        runs, anchors = np.zeros(len(n), np.int64), n.copy()
        if difflib:
            long = rights[n[rights] >= 200]
            if flat.max() < BINS:
                anchors[long] = np.where(letters[long] <= n[long, None] // 100 + 1, letters[long], 0).sum(1)
            else:
                anchors[long] = [_anchors(flat[starts[k] : starts[k] + n[k]]) for k in long.tolist()]
            least = np.ceil((n[long] + np.ceil(n[long] * (t / (2 - t)) - EPS)) * (t / 2) - EPS)
            runs[long] = np.ceil(least / (anchors[long] + 1) - EPS)
        rare = runs[rights] >= GRAM
        names = [rows[k].combine_chunks().dictionary_encode().indices.to_numpy() for k in keys]
        pieces = [(q, np.zeros((len(n), bins), np.uint8), np.zeros(len(n), np.bool_)) for q, bins in kinds]
        lists = windows(rights[~rare])
        met_by = np.unique(np.concatenate([lists[0], lists[1]]))
        where = np.zeros(len(n), np.int64)
        where[met_by] = np.arange(len(met_by))
        codes = np.concatenate([flat[starts[k] : starts[k] + n[k]] for k in met_by.tolist()]) if len(met_by) else flat[:0]
        signs = [(2, _bits(codes, n[met_by], 2, 512, 2))] if len(lists[0]) and short_of(t, 2) is not None else []

        def counted(q: int, of: np.ndarray, known: np.ndarray, i: np.ndarray) -> np.ndarray:
            need = np.unique(i[~known[i]])
            if len(need):
                own = np.concatenate([flat[starts[k] : starts[k] + n[k]] for k in need.tolist()])
                of[need] = np.concatenate([c.astype(np.uint8) for c in _counts(own, n[need], q, of.shape[1])])  # modulo 256
                known[need] = True
            return of[i]

        def apart(i: np.ndarray, j: np.ndarray, q: int) -> np.ndarray:
            """By how many pieces of q characters two strings may differ."""
            size = n[i] + n[j]
            shared = np.ceil(size * (t / 2) - EPS).astype(np.int64)
            most = size - 2 * shared + 1
            if difflib:
                most = np.where(n[j] < 200, most, np.minimum(most, anchors[j] + 1))
            return np.maximum(n[i] - q + 1, 0) + np.maximum(n[j] - q + 1, 0) - 2 * (shared - (q - 1) * most)

        def likely(i: np.ndarray, j: np.ndarray):
            for q, signs_of in signs:
                good = np.bitwise_count(signs_of[where[i]] ^ signs_of[where[j]]).sum(1, dtype=np.int32) <= apart(i, j, q)
                i, j = i[good], j[good]
            return i, j

        def met():
            """Pairs ``i, j`` that counts let through, and the most characters that they may share."""
            for i, j in _dense(t, n, letters, *lists):
                for c in range(0, len(i), BLOCK):
                    yield likely(i[c : c + BLOCK], j[c : c + BLOCK])
            if rare.any():
                yield from _sparse(t, n, flat, cells, runs, *windows(rights[rare]))

        def able(i: np.ndarray, j: np.ndarray):
            for code in names:  # of keys that differ and share a hash
                same = code[i] == code[j]
                i, j = i[same], j[same]
            bound = None
            for q, of, known in pieces:
                a, b = counted(q, of, known, i), counted(q, of, known, j)
                far = np.minimum(a - b, b - a).sum(1, dtype=np.int32)
                good = far <= apart(i, j, q)
                if q == 2:  # M - runs <= pieces shared, and runs <= size - 2 M + 1
                    grams = np.maximum(n[i] - 1, 0) + np.maximum(n[j] - 1, 0)
                    bound = ((grams - far) // 2 + n[i] + n[j] + 1)[good] // 3
                elif bound is not None:
                    bound = bound[good]
                i, j = i[good], j[good]
            own = np.minimum(letters[i], letters[j]).sum(1)
            bound = own if bound is None else np.minimum(own, bound)
            good = 2 * bound >= t * (n[i] + n[j]) - EPS
            return i[good], j[good], bound[good]

        def given(i, j, **more):
            i, j = pa.array(i), pa.array(j)
            columns = [*(rows[k].take(i).combine_chunks() for k in keys), rows["text"].take(i).combine_chunks(), rows["text"].take(j).combine_chunks()]
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, more.values())], [*keys, "left", "right", *more])

        top = np.full(len(n) if best else 0, t)
        found: list[tuple] = []
        def rate(i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> None:
            """Takes pairs by falling bounds of each left string, and rates those that may be its best."""
            size = n[i] + n[j]
            bound = 2 * bound / size
            order = np.lexsort((-bound, i))
            i, j, size, bound = i[order], j[order], size[order], bound[order]
            new = np.ones(len(i), np.bool_)
            new[1:] = i[1:] != i[:-1]
            rank = np.arange(len(i)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            done, many = 0, 1
            while len(rank) and done <= rank.max():
                k = np.flatnonzero((rank >= done) & (rank < done + many) & (bound >= top[i] - EPS))
                done, many = done + many, many * 4
                x, y = [text[m] for m in i[k].tolist()], [text[m] for m in j[k].tolist()]
                most, short = bound[k], np.flatnonzero(n[j[k]] < 200)  # of longer ones the ratio itself costs no more
                most[short] = 2 * similarity.common([x[m] for m in short.tolist()], [y[m] for m in short.tolist()]) / size[k[short]]
                for m in np.lexsort((-most, i[k])).tolist():
                    own = i[k[m]]
                    if most[m] >= top[own] - EPS and x[m] != y[m]:
                        score = similarity.ratio_of(x[m], y[m], top[own])
                        if score is not None:
                            top[own] = score
                            found.append((own, j[k[m]], score))

        def told():
            x, y, score = (np.array(of) for of in zip(*found))
            found.clear()
            good = score == top[x]
            return given(x[good], y[good], score=score[good])

        for i, j in met():
            for c in range(0, len(i), BLOCK):
                x, y, bound = able(i[c : c + BLOCK], j[c : c + BLOCK])
                if best:
                    good = 2 * bound >= (top[x] - EPS) * (n[x] + n[y])
                    rate(x[good], y[good], bound[good])
                    if len(found) >= BLOCK:  # many are equally good
                        yield told()
                    continue
                a, b = [text[k] for k in x.tolist()], [text[k] for k in y.tolist()]
                good = 2 * similarity.common(a, b) >= t * (n[x] + n[y]) - EPS
                good &= np.array([p != q for p, q in zip(a, b)], np.bool_)
                yield given(x[good], y[good])
        if found:
            yield told()

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            cell = batch.column("cell").to_numpy()
            if size >= PART and cell[0] != cell[-1]:
                whole = pa.Table.from_batches(held)
                end = whole.num_rows - batch.num_rows + int(np.flatnonzero(cell == cell[-1])[0])
                yield from near(whole.slice(0, end))
                held = whole.slice(end).combine_chunks().to_batches()
                size = whole.num_rows - end
        if held:
            yield from near(pa.Table.from_batches(held))

    return run


def candidates(left: DataFrame, right: DataFrame, keys: list[str], t: float, difflib: bool = False, best: bool = False) -> DataFrame:
    """``keys, left, right``: pairs of different strings of two tables within equal keys whose common
    subsequence allows t; with ``difflib`` without some that its ratio, left one first, keeps below t.
    With ``best`` also ``score``, that ratio, and the best pairs of each left string in each cell only.

    Both tables have ``keys, text``; blank and null strings meet nothing.
    """
    n = F.col("n")
    side = lambda d, s: d.where(F.col("text") != "").dropna(subset=keys).select(*keys, "text").distinct().withColumns({"side": F.lit(s), "n": F.length("text").cast("bigint")})
    reach = F.sequence(band(F.ceil(n * (t / (2 - t)) - EPS), t), band(F.floor(n * ((2 - t) / t) + EPS), t))
    both = side(left, 0).withColumn("band", F.explode(reach)).unionByName(side(right, 1).withColumn("band", band(n, t)))
    mine = lambda s: F.ceil(F.greatest(F.lit(1), F.count_if(F.col("side") == s) / PART, F.sum(F.when(F.col("side") == s, n)) / CHARS)).cast("int")
    # of large cells only, a row for PART strings or CHARS characters at most, so this may be broadcast
    parts = both.groupBy(*keys, "band").agg(mine(0).alias("parts_a"), mine(1).alias("parts_b")).where("parts_a > 1 OR parts_b > 1")
    first = F.col("side") == 0
    dealt = both.join(shared.save(parts, "parts"), [*keys, "band"], "left").na.fill(1, ["parts_a", "parts_b"]).withColumn("own", F.pmod(F.xxhash64("text"), F.when(first, F.col("parts_a")).otherwise(F.col("parts_b"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(first, F.col("parts_b")).otherwise(F.col("parts_a")) - 1)))
    part = [F.when(first, F.col(x).cast("bigint")).otherwise(F.col(y).cast("bigint")) for x, y in (("own", "other"), ("other", "own"))]
    rows = dealt.select(*keys, "text", "side", "n", F.xxhash64(*keys, "band", *part).alias("cell"))
    # a number of tasks is given, as adaptive ones are sized by bytes and these by pairs
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"`{k}` {dict(left.dtypes)[k]}" for k in keys)
    return rows.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(_met(t, keys, difflib, best), f"{kinds}, left string, right string" + ", score double" * best)


def _equal(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    equal = left.where(F.col("text") != "").select(*keys, "text").distinct().join(right.select(*keys, "text").distinct().hint("merge"), [*keys, "text"])
    return equal.select(*keys, F.col("text").alias("left"), F.col("text").alias("right"), F.lit(1.0).alias("score"))


def pairs(left: DataFrame, right: DataFrame, keys: list[str], t: float) -> DataFrame:
    """``keys, left, right, score``: pairs of strings within equal keys whose ratio is t or more; equal
    strings have 1."""
    scored = candidates(left, right, keys, t, True).withColumn("score", similarity.ratio_from(t)("left", "right"))
    return _equal(left, right, keys).unionByName(scored.where("score IS NOT NULL"))


def best(left: DataFrame, right: DataFrame, keys: list[str], t: float) -> DataFrame:
    """The rows of ``pairs`` with the best score of each left string, and a few more.  Only equal strings
    have 1, so left strings that the right side has as well are compared with no other."""
    rest = left.select(*keys, "text").distinct().join(right.select(*keys, "text").distinct().hint("merge"), [*keys, "text"], "left_anti")
    near = candidates(shared.save(rest, "rest"), right, keys, t, True, True)
    return _equal(left, right, keys).unionByName(near)
