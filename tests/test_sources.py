from __future__ import annotations

import csv
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerpitch.operators import latest, upsert
from ledgerpitch.sources import lists

MAPPING = (
    "fantacalcio_id int, api_player_id int, season string, method string, confidence double,"
    "status string, note string, updated_at timestamp"
)


def row(id, role="P", name="Portiere", current=10, initial=8, diff=None, fvm=50):
    diff = current - initial if diff is None else diff
    return [id, role, "Por", name, "Test FC", current, initial, diff, current, initial, current - initial, fvm, fvm]


def sheet(path, rows, headers=None):
    with open(path, "w", newline="", encoding="utf-8") as stream:
        writer = csv.writer(stream)
        writer.writerow(headers or list(lists.LIST_HEADERS))
        writer.writerows(rows)
    return str(path)


def test_price_list_loads_once(spark, tmp_path):
    folder = tmp_path / "Quotazioni_Fantacalcio_Stagione_2025_26"
    folder.mkdir()
    active = sheet(folder / "Tutti.csv", [row(1), [None] * 13])
    sold = sheet(folder / "Ceduti.csv", [row(2, "A", " Ceduto ", fvm=1)])
    rows = lists.read_price_list(spark, active, sold)
    got = {r["fantacalcio_id"]: (r["status"], r["quote_diff"], r["name"]) for r in rows.collect()}
    assert got == {1: ("active", 2, "Portiere"), 2: ("ceduto", 2, "Ceduto")}
    header = lists.snapshot_header(rows, lists.file_identity(spark, [active, sold]), "2025/26")
    first = header.first()
    assert first["snapshot_id"].startswith("listone-2025-26-") and len(first["snapshot_id"]) == 32
    assert (first["record_count"], first["active_count"], first["ceduti_count"]) == (2, 1, 1)
    snapshots = header.limit(0)
    players = rows.withColumns({"snapshot_id": F.lit(""), "season": F.lit("")}).limit(0)
    snapshots, players, added = lists.insert_snapshot(snapshots, players, header, rows)
    assert added and players.count() == 2
    _, _, again = lists.insert_snapshot(snapshots, players, header, rows)
    assert not again
    assert latest.season_summary(snapshots).first()["record_count"] == 2
    assert latest.latest_players(players, snapshots).count() == 2


@pytest.mark.parametrize(
    "rows,message",
    [
        ([row(1), row(1)], "more than once"),
        ([row(1, role="X")], "unknown role"),
        ([row(1, diff=7)], "quote_diff is inconsistent"),
        ([row("a")], "fantacalcio_id is not an integer"),
    ],
)
def test_wrong_rows_refuse_the_list(spark, tmp_path, rows, message):
    active = sheet(tmp_path / "a.csv", rows[:1])
    sold = sheet(tmp_path / "b.csv", rows[1:])
    with pytest.raises(ValueError, match=message):
        lists.read_price_list(spark, active, sold)


def test_wrong_header_fails(spark, tmp_path):
    headers = list(lists.LIST_HEADERS)
    headers[3] = "Name"
    with pytest.raises(Exception, match="(?i)header|conform"):
        lists.read_sheet(spark, sheet(tmp_path / "a.csv", [row(1)], headers), "Tutti").collect()


def test_discovery_matches_names_and_reads_seasons(spark, tmp_path):
    for name in ("Quotazioni_Fantacalcio_Stagione_2025_26.csv", "other.csv"):
        (tmp_path / name).write_text("x")
    found = lists.discover(spark, str(tmp_path)).collect()
    assert [r["season"] for r in found] == ["2025/26"]


def test_mapping_decisions(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("fantacalcio_id,api_player_id,season,status,note\n1,10,2026/27,accepted,\n2,,2026/27,excluded,gone\n3,30,2026/27,,\n")
    decisions = lists.read_mapping_decisions(spark, str(path))
    got = {r["fantacalcio_id"]: (r["api_player_id"], r["status"], r["method"], r["note"]) for r in decisions.collect()}
    assert got == {1: (10, "accepted", "manual", "manual CSV"), 2: (0, "excluded", "manual", "gone"), 3: (30, "accepted", "manual", "manual CSV")}
    old = spark.createDataFrame(
        [(1, 11, "2026/27", "x", 0.8, "pending", None, dt.datetime(2026, 1, 1)),
         (1, 12, "2026/27", "x", 1.0, "accepted", None, dt.datetime(2026, 1, 1)),
         (1, 13, "2025/26", "x", 0.8, "pending", None, dt.datetime(2026, 1, 1))],
        MAPPING,
    )
    kept = lists.apply_mapping_decisions(old, decisions)
    assert sorted((r["fantacalcio_id"], r["api_player_id"]) for r in kept.collect()) == [(1, 10), (1, 12), (1, 13), (2, 0), (3, 30)]
    path.write_text("fantacalcio_id,api_player_id,season\n1,,2026/27\n")
    with pytest.raises(ValueError, match="decisions are wrong"):
        lists.read_mapping_decisions(spark, str(path))
    path.write_text("fantacalcio_id,season\n1,2026/27\n")
    with pytest.raises(ValueError, match="lacks"):
        lists.read_mapping_decisions(spark, str(path))


def test_overrides(spark, tmp_path):
    header = "fantacalcio_id,season,valid_from,valid_to,expected_start_share,penalty_rank,set_piece_rank,risk_modifier,note,source,author\n"
    path = tmp_path / "o.csv"
    path.write_text(header + "2764,2026/27,2026-08-05,,0.9,1,,0.05,Rigorista,manuale,test\n5,2026/27,2026-08-05,,,,,,,manuale,test\n")
    rows = lists.read_overrides(spark, str(path))
    got = {r["fantacalcio_id"]: (r["expected_start_share"], r["penalty_rank"], r["risk_modifier"], r["valid_to"]) for r in rows.collect()}
    assert got == {2764: (0.9, 1, 0.05, None), 5: (None, None, 0.0, None)}
    assert lists.apply_overrides(rows, rows).count() == 2
    live = latest.current_overrides(rows, "2026/27", F.lit(dt.date(2026, 8, 4)))
    assert live.count() == 0
    for bad in ("1,2026/27,2026-08-05,,1.5,,,,,a,b", "1,2026/27,2026-08-05,,,,,2,,a,b", "1,2026/27,2026-08-05,,x,,,,,a,b"):
        path.write_text(header + bad + "\n")
        with pytest.raises(ValueError, match="overrides are wrong"):
            lists.read_overrides(spark, str(path))


def test_partition_upsert_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(2024, 1, 0), (2024, 2, 0), (2025, 1, 0)], "year int, id int, seq int")
    upsert.write_partitions(base, path, ["year"])
    untouched = {f.name for f in (tmp_path / "t" / "year=2024").iterdir()}
    new = spark.createDataFrame([(2025, 1, 2), (2025, 1, 1), (2025, 3, 1)], "year int, id int, seq int")
    for _ in range(2):
        upsert.upsert_path(spark, path, new, ["year", "id"], ["seq"], ["year"])
    rows = sorted(tuple(r) for r in spark.read.parquet(path).select("year", "id", "seq").collect())
    assert rows == [(2024, 1, 0), (2024, 2, 0), (2025, 1, 2), (2025, 3, 1)]
    assert {f.name for f in (tmp_path / "t" / "year=2024").iterdir()} == untouched
