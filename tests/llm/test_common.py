from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerpitch.llm import common


@pytest.mark.parametrize(("texts", "rows"), [(100, 20), (100, 200), (3000, 50)])
def test_sample_is_whole_whatever_the_copies(spark, texts, rows):
    docs = spark.range(60_000).select(F.concat(F.lit("text "), F.col("id") % texts).alias("text"))
    got = {r["text"] for r in common.sample_by_hash(docs, rows, "text").collect()}
    hashes = docs.distinct().select("text", F.xxhash64("text").alias("h")).collect()
    assert got == {r["text"] for r in sorted(hashes, key=lambda r: r["h"])[:rows]}


def test_bound_is_widened_where_the_estimate_is_too_high(spark, monkeypatch):
    monkeypatch.setattr(common.F, "approx_count_distinct", lambda c: F.lit(10_000_000))
    docs = spark.range(1000).select(F.col("id").cast("string").alias("text"))
    assert common.sample_by_hash(docs, 40, "text").count() == 40
