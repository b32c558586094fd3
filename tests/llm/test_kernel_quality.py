from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerpitch.llm import kernel_quality as kq

LABELS = "doc_id long, quality int, toxic int"


def fold_of(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        own = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        kind = rng.randrange(3)
        if not good:
            own = [[own[0]] * len(own), [w.upper() + "!!" for w in own], [w + rng.choice("#%&*") * 3 for w in own]][kind]
        docs.append((k, " ".join(own), "en"))
        if rng.random() < 0.8:
            labels.append((k, int(good), 0))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)


def by_id(df):
    return {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in df.collect()}


def test_held_out_accuracy_and_columns(spark):
    docs, labels = made(600)
    got = by_id(kq.quality_scores(*frames(spark, docs, labels)))
    assert len(got) == 600
    assert all(h == (fold_of(k) == 0) and 0 <= s <= 1 and p == int(s >= 0.3) for k, (h, s, p) in got.items())
    held = [(q, got[k][2]) for k, q, _ in labels if fold_of(k) == 0]
    assert len(held) > 60 and sum(q == p for q, p in held) >= 0.97 * len(held)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = made(200, 2)
    docs_, labels_ = frames(spark, docs, labels)
    other = [(k, 1 - q if fold_of(k) == 0 else q, 1 - t) for k, q, t in labels] + [(None, 0, 0), (3, None, 0)]
    odd = docs_.withColumns({c: F.lit(1) for c in ("fold", "stats", "label", "quality", "score")}).withColumn("lang", F.lit("x"))
    a = by_id(kq.quality_scores(docs_, labels_))
    b = by_id(kq.quality_scores(odd.repartition(7), spark.createDataFrame(other, LABELS)))
    assert {k: v[::2] for k, v in a.items()} == {k: v[::2] for k, v in b.items()}
    assert all(a[k][1] == pytest.approx(b[k][1], abs=1e-6) for k in a)


def test_model_equals_brute_force(spark):
    """The sums over tasks give what one matrix of all rows gives."""
    docs, labels = made(150, 3)
    docs_, labels_ = frames(spark, docs, labels)
    got = by_id(kq.quality_scores(docs_.repartition(6), labels_))
    known = {k: q for k, q, _ in labels if fold_of(k)}
    rows = {k: np.array(kq.text_statistics(t.encode()), np.float32).astype(float) for k, t, _ in docs}
    ids = [k for k in rows if k in known]
    x, y, folds = np.array([rows[k] for k in ids]), np.array([known[k] for k in ids], float), np.array([fold_of(k) for k in ids])
    spread = x.std(0)
    features = kq.FourierFeatures(x.mean(0), np.where(spread > 1e-6, spread, 1.0))
    waves = features.of(x)
    solve = lambda own: kq.ridge(waves[own].T @ waves[own], waves[own].T @ y[own], own.sum())
    left_out = np.concatenate([waves[folds == f] @ solve(folds != f) for f in sorted(set(folds))])
    truth = np.concatenate([y[folds == f] for f in sorted(set(folds))])
    bins = kq._bins(left_out)
    used = np.unique(bins)
    weights = np.array([(bins == b).sum() for b in used], float)
    shares = np.array([truth[bins == b].mean() for b in used])
    knots = kq.LOWEST + (used + 0.5) * (kq.HIGHEST - kq.LOWEST) / kq.BINS
    final = solve(np.ones(len(y), bool))
    for k, row in rows.items():
        want = np.interp((features.of(row[None]) @ final)[0], knots, kq.isotonic(shares, weights))
        assert got[k][1] == pytest.approx(want, abs=1e-5)


def test_kernel_is_approximated():
    rng = np.random.default_rng(5)
    size = 6
    features = kq.FourierFeatures(np.zeros(size), np.ones(size), 4000)
    a, b = rng.normal(0, 0.4, (2, 40, size))
    width = kq.WIDTH * np.sqrt(size)
    want = np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * width**2))
    got = features.of(a)[:, :-1] @ features.of(b)[:, :-1].T
    assert np.abs(got - want).max() < 0.12


def test_isotonic_equals_brute_force():
    rng = random.Random(6)
    for _ in range(50):
        n = rng.randrange(1, 9)
        values, weights = np.array([rng.randrange(5) for _ in range(n)], float), np.array([rng.randrange(1, 4) for _ in range(n)], float)
        got = kq.isotonic(values, weights)
        mean = lambda i, j: (values[i:j] * weights[i:j]).sum() / weights[i:j].sum()  # noqa: E731, B023
        want = [max(min(mean(i, j) for j in range(k + 1, n + 1)) for i in range(k + 1)) for k in range(n)]
        assert got == pytest.approx(want)


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (9, 0, 1)], LABELS)
    rows = kq.quality_scores(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}
    none = kq.quality_scores(odd_docs, spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert kq.quality_scores(no_docs, labels).count() == 0
    one = kq.quality_scores(odd_docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)).collect()
    assert {r["predicted"] for r in one} == {1}
