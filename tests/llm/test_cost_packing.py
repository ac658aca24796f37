import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from quillspark.llm import catalogue, cost_packing as C

PATH = catalogue.vocabulary("byte_bpe_50k.json")


def held(rows, size):
    """Sequences are gapless, none is padded, and each id lies in one piece."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at == size or at < size and at & (at - 1) == 0
    return sequences, docs


def test_balance_fills_every_sequence():
    rng = random.Random(3)
    for size in (1, 2, 16, 64):
        for n in (0, 1, 5, 60):
            for last in (False, True):
                lengths = [rng.randrange(1, 3 * size + 1) for _ in range(n)]
                placed, left, made = C.balance(lengths, size, last)
                seen = sorted([(i, s, k) for i, s, k, _, _ in placed] + left)
                for item, total in enumerate(lengths):
                    at = 0
                    for _, start, k in [x for x in seen if x[0] == item]:
                        assert start == at
                        at += k
                    assert at == total
                assert sum(k for _, _, k in left) == (0 if last else sum(lengths) % size)
                used = defaultdict(list)
                for _, _, k, s, offset in placed:
                    used[s].append((offset, k))
                assert set(used) == set(range(made))
                for own in used.values():
                    own.sort()
                    ends = np.cumsum([k for _, k in own])
                    assert [o for o, _ in own] == [0, *ends[:-1]]
                    assert ends[-1] == size or last and ends[-1] & (ends[-1] - 1) == 0


def test_each_piece_goes_to_the_lowest_cost_with_room():
    placed, _, made = C.balance([9, 8, 7, 3, 3, 2], 16, True, 1, 1)
    assert made == 2 and sorted(placed) == [(0, 0, 9, 0, 0), (1, 0, 8, 1, 0), (2, 0, 7, 1, 8), (3, 0, 3, 0, 9), (4, 0, 3, 0, 12), (5, 0, 1, 0, 15), (5, 1, 1, 1, 15)]


def test_costs_are_more_even_than_in_order_of_arrival():
    rng = random.Random(1)
    lengths = [min(1024, int(rng.lognormvariate(5, 1)) + 1) for _ in range(3000)]
    cost = lambda n: C.LINEAR * n + C.QUADRATIC * n * n

    def spread(pieces):
        total = defaultdict(int)
        for s, n in pieces:
            total[s] += cost(n)
        full = [v for s, v in total.items()][:-10]
        return max(full) - min(full)

    placed, _, _ = C.balance(lengths, 1024, False)
    at, plain = 0, []
    for n in lengths:
        while n:
            k = min(n, 1024 - at % 1024)
            plain.append((at // 1024, k))
            at, n = at + k, n - k
    whole = [(s, n) for _, _, n, s, _ in placed if n < 1024]
    assert spread(whole) < spread(plain)


def test_pieces_against_the_library(spark, odd, odd_rows):
    library = Tokenizer.from_file(PATH)
    for window in (3, 4096):
        rows = C.pack(odd, PATH, size=64, window=window, with_ids=True).collect()
        held(rows, 64)
        want = sorted((d is not None, d or 0, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in odd_rows)
        tokens = defaultdict(int)
        for r in rows:
            ids = np.frombuffer(bytes(r.ids), "<u4")
            assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
            tokens[r.doc_id] += r.length
        assert sum(tokens.values()) == sum(len(ids) for _, _, ids in want)
        once = {d: i for _, d, i in want}
        for d in (1, 3, 4, 5, 6, 9, 10, 12):
            own = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == d)
            assert tuple(np.frombuffer(b"".join(x for _, x in own), "<u4")) == once[d] and {r.doc_tokens for r in rows if r.doc_id == d} == {len(once[d])}


def test_packing_of_an_empty_table(spark, empty):
    assert C.pack(empty, PATH).collect() == []


def test_query_packs_every_document(spark, sf):
    rows = catalogue.queries()["op13_cost_packing"](spark, sf).collect()
    _, docs = held(rows, 1024)
    library = Tokenizer.from_file(PATH)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert set(docs) == {r.doc_id for r in table}
    for r in table[:50]:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted((p for p in rows if p.doc_id == r.doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
