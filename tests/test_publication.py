from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from ledgerpitch.operators import commits
from ledgerpitch.queries import publication
from ledgerpitch.sources import exports, raw


def table(spark, rows):
    return spark.createDataFrame(rows, "parent int, value string").repartition(3, "parent")


def rows_of(spark, root, name):
    return sorted(tuple(r) for r in commits.read(spark, commits.snapshot(spark, root).tables[name]).collect())


def test_tables_change_together_and_late_writers_fail(spark, tmp_path):
    root = str(tmp_path)
    empty = commits.snapshot(spark, root)
    assert empty == commits.Snapshot(0, {})
    many = [(p, "old") for p in range(40)]
    base = commits.commit(spark, root, empty, {n: commits.stage(root, n, table(spark, many)) for n in ("a", "b", "c")})
    parents = spark.createDataFrame([(3,), (3,), (99,)], "parent int")
    new = table(spark, [(3, "new"), (3, "more")])
    changed = {n: commits.stage_children(root, n, base.tables[n], new, parents, "parent") for n in ("a", "b")}
    assert rows_of(spark, root, "a") == many and commits.snapshot(spark, root).version == 1
    after = commits.commit(spark, root, base, changed)
    want = sorted([r for r in many if r[0] != 3] + [(3, "new"), (3, "more")])
    assert rows_of(spark, root, "a") == rows_of(spark, root, "b") == want and rows_of(spark, root, "c") == many
    assert set(base.tables["a"].files) & set(after.tables["a"].files), "untouched files are carried over"
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, base, changed)
    assert commits.snapshot(spark, root) == after
    old = commits.snapshot(spark, root, 1)
    assert sorted(tuple(r) for r in commits.read(spark, old.tables["a"]).collect()) == many
    none = commits.stage_children(root, "n", commits.Table(base.tables["a"].schema, ()), new, parents, "parent")
    assert commits.read(spark, none).count() == 2
    gone = commits.stage(root, "e", table(spark, many).limit(0))
    assert commits.read(spark, gone).count() == 0


def test_broken_responses_are_rows(spark, tmp_path):
    good = '{"b": 2, "a": [1, 2]}'
    for name, content in {
        "good.json": good.encode(),
        "good.json.gz": gzip.compress(good.encode()),
        "cut.json.gz": gzip.compress(good.encode())[:-6],
        "plain.json.gz": good.encode(),
        "bytes.json": b"\xff\xfe\x00",
        "half.json": good[:9].encode(),
        "empty.json": b"",
        "other.json": b'{"a": [1, 3], "b": 2}',
        "new.json": good.encode(),
    }.items():
        (tmp_path / name).write_bytes(content)
    names = ("good.json", "good.json.gz", "cut.json.gz", "plain.json.gz", "bytes.json", "half.json", "empty.json", "other.json", "gone.json")
    requests = spark.createDataFrame([("players", "{}", good, n) for n in names], "endpoint string, params string, body string, cache_path string")
    index = raw.index_rows(requests)
    found = raw.verified_bodies(spark, str(tmp_path), index, lambda path: F.element_at(F.split(path, "/"), -1))
    got = {r["cache_path"]: r["reason"] for r in found.collect()}
    assert got == {
        "good.json": None, "good.json.gz": None, "cut.json.gz": raw.BROKEN_GZIP, "plain.json.gz": raw.BROKEN_GZIP, "bytes.json": raw.NOT_TEXT,
        "half.json": raw.NOT_JSON, "empty.json": raw.NO_FILE, "other.json": raw.OTHER_CONTENT, "new.json": raw.NOT_INDEXED, "gone.json": raw.NO_FILE,
    }


def test_files_that_differ_from_their_manifest_are_not_published(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "season int, fantacalcio_name string")
    build = spark.createDataFrame([("x",)], "build_id string")
    root = str(tmp_path / "good")
    listed = exports.publish_verified(spark, root, lambda r: exports.export_pending(rows, r), build)
    assert listed.count() >= 1 and exports.read_published(spark, root, "pending_csv").count() == 2
    part = next((tmp_path / "good" / "pending_csv").glob("part-*"))
    part.write_text(part.read_text() + "3,c\n")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert exports.differences(spark, root) == [f"pending_csv/{part.name}"]
    bad = str(tmp_path / "bad")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        exports.read_published(spark, bad, "pending_csv")


def test_an_empty_diff_is_one_header_line(spark, tmp_path):
    diff = spark.createDataFrame([], "change_type string, role string, name string")
    exports.export_diff(diff, str(tmp_path))
    assert [p.read_text() for p in (tmp_path / "diff_csv").glob("part-*")] == ["change_type\n"]


def test_bodies_are_landed_by_many_tasks(spark, tmp_path):
    bodies = spark.range(200).selectExpr("id as file", "concat('{\"response\":[', id, ']}') as value").coalesce(1)
    publication._land(bodies, f"{tmp_path}/landed", compression="gzip")
    found = sorted(tmp_path.glob("landed/file=*/part-*.txt.gz"))
    assert [p.parent.name for p in found] == sorted(f"file={k}" for k in range(200))
    assert len({p.name.split("-")[1] for p in found}) > spark.sparkContext.defaultParallelism
