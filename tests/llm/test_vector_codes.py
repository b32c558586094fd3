from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerpitch.llm import vector_codes
from ledgerpitch.llm.vector_codes import Assigner

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, rounds=2, entries=64, parts=16):
    """The contract in plain integers: no bounds, every part against every entry."""
    kept = []
    for vec_id, vector, label in rows:
        if vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(r[1])[p] for r in kept[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, book: min((distance(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members: dict[int, list] = {}
            for _, v, _ in kept:
                members.setdefault(nearest(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            for k, own in members.items():
                books[p][k] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    out, totals = [], {}
    for vec_id, v, label in kept:
        found = [nearest(part, book) for part, book in zip(cut(v), books, strict=True)]
        error = sum(d for d, _ in found)
        totals[label] = totals.get(label, 0) + error
        out.append((vec_id, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, c, e, totals[lab], digest) for i, c, e, lab in out)


def made(seed, n, dims=32):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        label = rng.choice([None, 0, 1, 2])
        rows.append((i * 7 % n + 1, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], label))
    return rows


def collected(df):
    return sorted(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("n", [150, 40])
def test_equals_brute_force(spark, n):
    rows = made(n, n)
    rows += [(9001, None, 1), (9002, [float("nan")] * 32, 1), (9003, [None] + [0.5] * 31, 1), (9004, [float("inf")] + [0.1] * 31, 2)]
    rows += [rows[3], (9005, rows[4][1], 0)]  # a repeated row, a tie
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("vector", "codes", "error", "part", "count")})
    assert collected(vector_codes.vector_codes(df.repartition(5))) == brute_force(rows)


def test_joins_when_labels_are_many(spark):
    rows = made(3, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.ledgerpitch.maxBroadcastRows", "1")
    try:
        assert collected(vector_codes.vector_codes(df)) == brute_force(rows)
    finally:
        spark.conf.unset("spark.ledgerpitch.maxBroadcastRows")


def test_empty_and_odd_tables(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 3)], SCHEMA)).count() == 0
    one = vector_codes.vector_codes(spark.createDataFrame([(None, [0.5] * 16, None)], SCHEMA)).first()
    assert (one["vec_id"], one["code"], one["error"], one["label_error"]) == (None, "00" * 16, 0, 0)
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.5] * 17, 0)], SCHEMA))


def test_bounds_keep_the_scan_exact_and_spare_distances():
    rng = np.random.default_rng(4)
    rows = rng.integers(-60, 60, (4000, 4))
    history = [rng.integers(-60, 60, (1, 64, 4))]
    assigner = Assigner(history)
    code, _, low, stamp = assigner.first(0, rows)
    for step in range(6):
        history.append(history[-1] + rng.integers(-3, 4, history[-1].shape))
        assigner = Assigner(history)
        code, near, low, stamp = assigner.again(0, rows, code, low, stamp)
        every = ((rows[:, None] - history[-1][0][None]) ** 2).sum(-1)
        assert (code == every.argmin(1)).all(), step
        assert (near == every.min(1)).all()
        assert assigner.scanned < 0.7 * every.size


def test_net_displacement_is_tighter_than_the_sum_of_steps():
    book = np.zeros((1, 4, 2), np.int64)
    there, back = book + 5, book + 1
    net = Assigner([book, there, back]).moved[0, 0].max()
    steps = Assigner([book, there]).moved[0, 0].max() + Assigner([there, back]).moved[0, 0].max()
    assert net < 0.2 * steps
