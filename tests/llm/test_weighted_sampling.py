from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np

from ledgerpitch.llm import weighted_sampling as ws


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_likeness_estimates_generalised_jaccard():
    sampler = ws.Sampler(samples=2000, rows=20_000)
    chance = np.random.default_rng(1)
    for _ in range(12):
        one = " ".join(f"w{x}" for x in chance.zipf(1.5, 300) % 400)
        two = " ".join(one.split()[: chance.integers(1, 300)]) + " " + " ".join(f"w{x}" for x in chance.integers(0, 600, 80))
        got = ws.likeness(sampler.fingerprint(one), sampler.fingerprint(two))
        assert abs(got - jaccard(one, two)) < 0.05


def test_a_small_cache_changes_nothing():
    large, small = ws.Sampler(64, 5000), ws.Sampler(64, 40)
    for n in range(30):
        text = " ".join(f"w{k * n % 37}" for k in range(30))
        assert (large.fingerprint(text) == small.fingerprint(text)).all()


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for at, (doc, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    return sorted(out, key=str)


def test_every_document_meets_the_next_one(spark):
    for n in (1, 2, 3, 200):
        rows = [(k * 7 % 211, f"é{k} " * (k % 5)) for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = ws.fingerprints(docs, samples=16).collect()
        assert sorted([tuple(r)[:3] for r in got], key=str) == expected(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    got = ws.fingerprints(odd_docs).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == expected(rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[8] == prints[9] and prints[1] == prints[2] and set(prints[4]) == {"-"}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 4)["near_edited"] == 1.0
    assert ws.fingerprints(no_docs).count() == 0
