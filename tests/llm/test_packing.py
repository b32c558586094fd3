from __future__ import annotations

import random
import zlib

import public_tokenizers

from ledgerpitch.llm import byte_bpe, packing
from ledgerpitch.llm.packing import Plan, _Stock, make_plan, reduce_instance


def bins_of(plan, counts):
    bins: dict[int, list[tuple[int, int]]] = {}
    for length, n in counts.items():
        runs = sorted(r for r in plan.runs if r[0] == length)
        for rank in range(n):
            _, first, per, sequence, offset = [r for r in runs if r[1] <= rank][-1]
            nth = rank - first
            bins.setdefault(sequence + nth // per, []).append((offset + nth % per * length, length))
    return bins


def is_valid(bins, capacity, sequences):
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(sequences))


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def go(at, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if at == len(items):
            best = len(loads)
            return
        for load in {x for x in loads if x + items[at] <= capacity}:
            k = loads.index(load)
            go(at + 1, [*loads[:k], load + items[at], *loads[k + 1 :]])
        go(at + 1, [*loads, items[at]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum_and_plans_are_valid():
    chance = random.Random(4)
    excess = 0
    for _ in range(250):
        capacity = chance.choice([10, 20, 50])
        counts: dict[int, int] = {}
        for _ in range(chance.randint(1, 9)):
            length = chance.randint(1, capacity)
            counts[length] = counts.get(length, 0) + 1
        items = [k for k, n in counts.items() for _ in range(n)]
        best = optimum(items, capacity)
        plan = make_plan(counts, capacity)
        is_valid(bins_of(plan, counts), capacity, plan.sequences)
        reduced, stock = Plan(), _Stock(counts)
        reduce_instance(stock, capacity, reduced)
        rest = [k for k, n in stock.counts.items() for _ in range(n)]
        assert reduced.sequences + (optimum(rest, capacity) if rest else 0) == best
        excess += plan.sequences - best
    assert excess <= 5


def test_plans_do_not_grow_with_the_documents():
    counts = {k: 1 + k % 7 for k in range(1, 1025)}
    small, large = make_plan(counts), make_plan({k: 10**9 * n for k, n in counts.items()})
    assert len(large.runs) < 4000 and large.sequences < 10**9 * small.sequences * 1.01
    is_valid(bins_of(small, counts), 1024, small.sequences)


def check(spark, docs, capacity=1024):
    library = byte_bpe.load(public_tokenizers.path(packing.TOKENIZER_FILE))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        for number, (start, length) in enumerate(packing.cut(len(ids), capacity)):
            own = b"".join(i.to_bytes(4, "little") for i in ids[start : start + length])
            want.append((r["doc_id"], number, start, length, zlib.crc32(own)))
    rows = packing.pack_documents(docs, capacity).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    bins: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    is_valid({at: b for at, b in enumerate(bins.values())}, capacity, len(bins))
    return bins


def test_documents_are_packed_whole(spark, odd_docs, no_docs):
    check(spark, odd_docs)
    check(spark, odd_docs, capacity=16)
    assert packing.pack_documents(no_docs).count() == 0
    ids = packing.pack_documents(odd_docs.filter("doc_id = 8"), with_ids=True).first()["ids"]
    assert len(ids) == 12


def test_pieces_put_the_shorter_one_first():
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(1, 1024) == [(0, 1)]
