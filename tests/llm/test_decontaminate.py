from __future__ import annotations

import random
from collections import Counter

import numpy as np

from ledgerpitch.llm import decontaminate as dc
from ledgerpitch.llm.shingles import WordHashes, shingle_hashes


def bag(words, width):
    if len(words) < width:
        return Counter([tuple(words)])
    return Counter(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute(docs, items, least=0.8):
    """The best similarity of every document and item over all windows, where it is enough."""
    out = {}
    for doc, text in docs:
        words = dc.plain_words(text or "")
        for item, item_text in items:
            target = dc.plain_words(item_text or "")
            if not target or not words:
                continue
            width = min(5, len(target))
            size = min(len(target), len(words))
            weights = bag(target, width)
            best = max(dc.similarity(bag(words[k : k + size], width), weights) for k in range(len(words) - size + 1))
            if best >= least:
                out[doc, item] = best
    return out


def made_up():
    chance = random.Random(7)
    words = [f"w{n}" for n in range(400)]
    text = lambda n: [chance.choice(words) for _ in range(n)]
    items = [(n, " ".join(text(chance.choice([2, 4, 5, 12, 30, 55])))) for n in range(30)]
    items += [(30, None), (31, "..."), (32, items[3][1].upper() + "!"), (33, items[3][1])]
    docs = []
    for n in range(150):
        own = text(chance.choice([1, 3, 40, 300]))
        if n % 3 == 0:
            passage = items[n % 30][1].split()
            for _ in range(chance.choice([0, 0, 1, 2])):
                passage[chance.randrange(len(passage))] = chance.choice(words)
            at = chance.randrange(len(own) + 1)
            own[at:at] = [w.capitalize() + chance.choice(["", ",", "###"]) for w in passage[: chance.choice([99, 99, len(passage) - 1])]]
        docs.append((n, " ".join(own)))
    return docs, items


def test_windows_against_brute_force(spark):
    docs, items = made_up()
    found = dc.contaminations(
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"),
        spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"),
    ).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 12) for r in found} == {k: round(v, 12) for k, v in want.items()}
    assert len(found) == len(want)
    by_doc = dict(docs)
    for r in found[:50]:
        window = dc.plain_words(by_doc[r["doc_id"]])[r["first_word"] : r["first_word"] + r["n_words"]]
        target = dc.plain_words(dict(items)[r["item_id"]])
        width = min(5, len(target))
        assert abs(dc.similarity(bag(window, width), bag(target, width)) - r["similarity"]) < 1e-12


def test_blocks_find_everything_within_the_radius():
    chance = np.random.default_rng(3)
    index = dc.SizeIndex(10, 6, items=[[n] for n in range(40)])
    own = chance.integers(0, 256, (40, 8)).astype(np.uint8)
    index.finish(list(own))
    probes = []
    for n in range(2000):
        bits = np.unpackbits(own[n % 40])
        bits[chance.permutation(64)[: chance.integers(0, 32)]] ^= 1
        probes.append(np.packbits(bits))
    probes = np.stack(probes)
    window, item, distance = index.within(probes)
    all_distances = np.bitwise_count(probes[:, None] ^ own[None]).sum(axis=2)
    want = {(w, i, all_distances[w, i]) for w, i in zip(*np.nonzero(all_distances <= dc.RADIUS), strict=True)}
    assert set(zip(window, item, distance, strict=True)) == want


def test_running_fingerprints_equal_single_ones():
    words = [f"w{n % 17}".encode() for n in range(80)]
    shingles = shingle_hashes(WordHashes().of(words))
    rolled = dc.simhashes(dc.bit_counts(shingles), 20)
    for at in range(0, len(rolled), 7):
        assert (rolled[at] == dc.simhashes(dc.bit_counts(shingles[at : at + 20]), 20)[0]).all()


def test_odd_rows_and_several_passes(spark, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, "two words"), (None, "word5 and5")], "item_id long, text string")
    want = {(1, 1), (2, 1), (8, 2), (9, 2), (6, None)}
    for size in (dc.PASS_BYTES, 20):
        monkeypatch.setattr(dc, "PASS_BYTES", size)
        got = dc.contaminations(odd_docs, items).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == 6
        clean = dc.without_benchmark(odd_docs, items)
        assert clean.columns == odd_docs.columns
        assert sorted([r["doc_id"] for r in clean.collect()], key=str) == [3, 4, 5, None, None]
    assert dc.contaminations(no_docs, items).count() == 0
    assert dc.contaminations(odd_docs, items.limit(0)).count() == 0
    assert dc.without_benchmark(odd_docs, items.limit(0)).count() == 11
