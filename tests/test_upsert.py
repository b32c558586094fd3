from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerpitch.functions import hashing
from ledgerpitch.operators import upsert


def stored(spark, path):
    rows = spark.range(1000).select((F.col("id") % 20).alias("part"), "id", F.lit(0).alias("seq"), F.lit("old").alias("v"))
    upsert.write_partitions(rows, path, ["part"])
    return rows


def test_an_upsert_opens_only_the_partitions_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    stored(spark, path)
    new = spark.createDataFrame([(3, 3, 1, "new"), (7, 2007, 1, "new")], "part long, id long, seq int, v string")
    old = upsert._touched_rows(spark.read.parquet(path), new, ["part"])
    scan = next(line for line in old._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    assert "part#" in scan.split("PartitionFilters: ")[1].split("]")[0] and "IN (3,7)" in scan
    assert {r["part"] for r in old.select("part").distinct().collect()} == {3, 7}
    upsert.upsert_path(spark, path, new, ["part", "id"], ["seq"], ["part"])
    after = spark.read.parquet(path)
    assert after.count() == 1001 and after.filter("v = 'new'").count() == 2


def test_many_touched_partitions_are_joined(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = stored(spark, path)
    monkeypatch.setattr(upsert, "LISTED_PARTITIONS", 5)
    upsert.upsert_path(spark, path, rows.withColumn("v", F.lit("new")), ["part", "id"], ["seq"], ["part"])
    assert spark.read.parquet(path).filter("v = 'new'").count() == 1000


def test_partitions_are_listed_by_path(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a b/c", 1), ("x", 2)], "part string, id int")
    upsert.write_partitions(rows, path, ["part"])
    assert upsert.listed_partitions(spark.read.parquet(path), "part") == ["a b/c", "x"]
    more = spark.createDataFrame([("x", 3), ("y", 4)], "part string, id int")
    assert [tuple(r) for r in upsert.insert_new_partitions(spark, path, more, "part").select("part", "id").collect()] == [("y", 4)]


def test_a_version_without_its_mark_is_not_read(spark, tmp_path):
    root = str(tmp_path / "mart")
    upsert.publish_version(spark.range(3), root, "0001")
    spark.range(9).write.parquet(f"{root}/version=0002")
    assert upsert.newest_version(spark, root).count() == 3
    upsert.publish_version(spark.range(5), root, "0003")
    assert upsert.newest_version(spark, root).count() == 5


def test_the_ledger_keeps_the_newest_state(spark):
    schema = "endpoint string, season_start int, status string, detail string, updated_at int"
    keys = ["endpoint", "season_start"]
    none = spark.createDataFrame([], schema)
    first = upsert.record_states(none, spark.createDataFrame([("/p", 1, "in_progress", "page 1", 1), ("/p", 2, "paused", "limit", 5)], schema), keys, ["updated_at"])
    later = spark.createDataFrame([("/p", 1, "complete", "", 3), ("/p", 1, "incomplete", "gap", 2), ("/p", 2, "in_progress", "late", 4)], schema)
    got = {tuple(r) for r in upsert.record_states(first, later, keys, ["updated_at"]).collect()}
    assert got == {("/p", 1, "complete", "", 3), ("/p", 2, "paused", "limit", 5)}
    with pytest.raises(ValueError, match="status"):
        upsert.record_states(none, later.withColumn("status", F.lit("done")), keys, ["updated_at"])


def test_a_table_without_a_key_is_never_ordered_in_one_task(spark, monkeypatch):
    rows = spark.range(3000)
    whole = hashing.ordered_fingerprint(rows, F.col("id").cast("string"), [F.col("id")], fan_out=10).first()[0]
    monkeypatch.setattr(hashing, "KEYLESS_ROWS", 100)
    seen = []
    plain = hashing.positions
    monkeypatch.setattr(hashing, "positions", lambda *a: seen.append(a[-1]) or plain(*a))
    assert hashing.ordered_fingerprint(rows, F.col("id").cast("string"), [F.col("id")], fan_out=10).first()[0] == whole
    assert seen == [100]
    numbered = plain(rows.withColumn("_all", F.lit(1)), ["_all"], [F.col("id")], "place", 100)
    assert numbered.filter("place = id + 1").count() == 3000


def plan_of(df):
    df.collect()  # the adaptive plan is final after a run
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast_rows, keys_per_task", [(10, 1_000_000), (10, 25), (1000, 1_000_000)])
def test_children_are_replaced_without_sorting_them(spark, monkeypatch, broadcast_rows, keys_per_task):
    monkeypatch.setattr(upsert, "KEYS_PER_TASK", keys_per_task, raising=False)
    old = spark.range(4000).select(F.when(F.col("id") % 40 != 39, F.col("id") % 1000).alias("parent"), F.col("id").alias("child"))
    parents = spark.range(600).select(F.when(F.col("id") % 50 != 49, F.col("id") % 300 * 3).alias("parent"))
    new = spark.createDataFrame([(3, -1), (3, -1), (5000, -2), (None, -3)], "parent long, child long")
    gone = {i % 300 * 3 for i in range(600) if i % 50 != 49}
    rows = [(None if i % 40 == 39 else i % 1000, i) for i in range(4000)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.ledgerpitch.maxBroadcastRows", str(broadcast_rows))
    try:
        got = upsert.replace_children(old, new, parents, "parent")
        plan = plan_of(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.ledgerpitch.maxBroadcastRows")
    assert "SortMergeJoin" not in plan
    assert ("BroadcastHashJoin" if broadcast_rows == 1000 else "ShuffledHashJoin") in plan
    # 600 rows by 25 keys are 24 partitions, where the session has 8
    assert (", 24), REPARTITION_BY_NUM" in plan) == (keys_per_task == 25)
    want = [r for r in rows if r[0] not in gone] + [(3, -1), (3, -1), (5000, -2), (None, -3)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
