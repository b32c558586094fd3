from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerpitch.llm import lsh_forest as lf
from ledgerpitch.llm.components import connected_components


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def components(rows, percent=85):
    """(shingles, least reachable id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for at, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(at)] = min(doc, least.get(find(at), doc))
    return sorted(
        ((d, len(sets[at]), least.get(find(at)) if d is not None else None) for at, (d, _) in enumerate(rows)), key=str
    )


def made_up(seed):
    chance = random.Random(seed)
    words = [f"w{n}" for n in range(3000)]
    rows = []
    for group in range(25):
        base = [chance.choice(words) for _ in range(chance.choice([3, 12, 60, 200]))]
        for _ in range(chance.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(chance.choice([0, 0, 1, 2, 4, 8])):
                copy[chance.randrange(len(copy))] = chance.choice(words)
            rows.append((len(rows) + 100 * (group % 3), " ".join(copy)))
    chance.shuffle(rows)
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (None, None), rows[1]]


@pytest.mark.parametrize(("seed", "group_shingles"), [(1, lf.GROUP_SHINGLES), (2, lf.GROUP_SHINGLES), (3, 400)])
def test_components_against_all_pairs(spark, seed, group_shingles):
    rows = made_up(seed)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, node string, coarse string")
    got = lf.near_duplicates(docs.repartition(4), group_shingles=group_shingles).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == components(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_one_large_group_of_near_copies(spark):
    chance = random.Random(9)
    base = [f"b{n}" for n in range(120)]
    rows = []
    for n in range(400):
        copy = list(base)
        for _ in range(chance.choice([1, 2])):
            copy[chance.randrange(120)] = f"x{n}"
        rows.append((n, " ".join(copy)))
    want = components(rows)
    for limit in (lf.GROUP_SHINGLES, 1000):
        got = lf.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), group_shingles=limit)
        assert sorted([tuple(r)[:3] for r in got.collect()], key=str) == want


def test_sets_are_linked_exactly():
    chance = random.Random(3)
    for _ in range(200):
        base = [chance.getrandbits(64) for _ in range(chance.choice([5, 40, 200]))]
        sets = []
        for _ in range(chance.randint(1, 30)):
            own = set(base) if chance.random() < 0.8 else {chance.getrandbits(64) for _ in range(30)}
            if sets and chance.random() < 0.3:
                own = set(chance.choice(sets).tolist())
            for x in list(own):
                if chance.random() < chance.choice([0, 0.02, 0.05, 0.1]):
                    own.discard(x)
                    own.add(chance.getrandbits(64))
            sets.append(np.array(sorted(own), np.uint64))
        parent = list(range(len(sets)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        assert lf.link_sets(sets) == [find(at) for at in range(len(sets))]


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = lf.near_duplicates(odd_docs).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == components(rows)
    assert lf.near_duplicates(no_docs).count() == 0
    kept = lf.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == [1, 3, 4, 5, 6, 8, None, None]


def test_components_of_graphs(spark):
    chain = [(n, n + 1) for n in range(60)] + [(100, 200), (300, 300), (200, 150), (None, 3)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(n, 0) for n in range(61)} | {(100, 100), (200, 100), (150, 100), (300, 300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
