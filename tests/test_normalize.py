from __future__ import annotations

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from ledgerpitch import schemas
from ledgerpitch.operators import normalize, upsert
from ledgerpitch.sources import raw



def person(number, name, **more):
    return {"id": number, "name": name, **more}


def match(number, home, away, goals, **lists):
    """A match of two (id, name) clubs; lists not named are left out of the response."""
    return {
        "fixture": {
            "id": number, "date": f"2024-02-{number % 28 + 1:02d}T14:30:00+01:00", "timezone": "Europe/Rome", "referee": None,
            "venue": {"id": 7000 + number, "name": f"Campo {number}", "city": "Pisa"}, "status": {"short": "PEN", "elapsed": 120},
        },
        "league": {"id": 136, "season": 2023, "round": f"Round {number}"},
        "teams": {"home": {"id": home[0], "name": home[1]}, "away": {"id": away[0], "name": away[1]}},
        "goals": {"home": goals[0], "away": goals[1]},
        "score": {"halftime": {"home": None, "away": None}, "fulltime": {"home": goals[0], "away": goals[1]}},
        **lists,
    }


ALBA, ROCCA, VALLE = (301, "Alba"), (302, "Rocca"), (303, "Valle")


def side(club, formation, starters, bench):
    wrap = lambda people: [{"player": p} for p in people]
    return {"team": {"id": club[0], "name": club[1]}, "formation": formation, "coach": {"id": club[0] * 10, "name": f"Mister {club[1]}"},
            "startXI": wrap(starters), "substitutes": wrap(bench)}


def happening(minute, club, who, kind, detail, extra=None, helper=None, comment=None):
    return {"time": {"elapsed": minute, "extra": extra}, "team": {"id": club[0]}, "player": who, "assist": helper or {"id": None, "name": None},
            "type": kind, "detail": detail, "comments": comment}


KEEPER, BACK, WING, LATE = person(41, "Portiere"), person(42, "Terzino"), person(43, "Ala"), person(44, "Entrato")
RIVAL = person(51, "Rivale")
LISTS = {
    "events": [
        happening(12, ROCCA, RIVAL, "Card", "Yellow Card", comment="foul"),
        happening(90, ALBA, WING, "Goal", "Penalty", extra=4),
        happening(90, ALBA, LATE, "subst", "Substitution 1", extra=5, helper=WING),
    ],
    "lineups": [
        # The bench names a starter again, and another entry of the club repeats a substitute.
        side(ALBA, "4-4-2", [{**KEEPER, "number": 1, "pos": "G", "grid": "1:1"}, {**WING, "number": 17, "pos": "M", "grid": "3:4"}],
             [{**WING, "number": 17, "pos": "M", "grid": None}, {**LATE, "number": 20, "pos": "F", "grid": None}]),
        side(ROCCA, None, [{**RIVAL, "number": None, "pos": None, "grid": None}], []),
        side(ALBA, "4-4-2", [], [{**LATE, "number": 99, "pos": "F", "grid": None}, {**BACK, "number": 2, "pos": "D", "grid": None}]),
    ],
    "statistics": [
        {"team": {"id": ROCCA[0], "name": "Rocca"}, "statistics": [{"type": "Corner Kicks", "value": 3}, {"type": "Passes %", "value": "n/a"}]},
        {"team": {"id": ALBA[0], "name": "Alba"}, "statistics": [
            {"type": "Ball Possession", "value": "41%"}, {"type": "Offsides", "value": 2}, {"type": "Offsides", "value": 1},
            {"type": "Made Up", "value": 8}, {"type": "Yellow Cards", "value": None}, {"type": "Total Shots", "value": "11"}]},
    ],
    "players": [
        {"team": {"id": ALBA[0], "name": "Alba"}, "players": [
            {"player": WING, "statistics": [{"games": {"minutes": 88, "position": "M", "rating": "six", "captain": True, "substitute": False},
                "goals": {"total": 2, "conceded": None, "assists": None, "saves": None}, "passes": {"total": 31, "key": 1, "accuracy": "74"},
                "penalty": {"won": 1, "commited": None, "scored": 1, "missed": 0, "saved": None}}]},
            {"player": KEEPER, "statistics": [{"games": {"minutes": 120, "position": "G", "rating": "6.25", "captain": False, "substitute": False},
                "goals": {"total": None, "conceded": 2, "assists": 0, "saves": 7}}]},
            {"player": BACK, "statistics": []}]},
        {"team": {"id": ROCCA[0], "name": "Rocca"}, "players": [
            {"player": RIVAL, "statistics": [{"games": {"minutes": None, "position": None, "rating": None, "captain": None, "substitute": True}}]}]},
    ],
}
FULL = match(9, ALBA, ROCCA, (2, 2), **LISTS)
BARE = match(10, VALLE, ALBA, (0, 1))


def land(tmp_path, name, response, zipped=True):
    body = json.dumps({"results": len(response), "paging": {"current": 1, "total": 2}, "response": response})
    folder = tmp_path / name
    folder.mkdir()
    if zipped:
        with gzip.open(folder / "a.json.gz", "wt", encoding="utf-8") as stream:
            stream.write(body)
    else:
        (folder / "a.json").write_text(body, encoding="utf-8")
    return str(folder)



def no_details(spark, rows):
    return spark.createDataFrame([], "fixture_id int").select(
        "fixture_id", *[F.lit(None).cast(rows.schema[name].dataType).alias(name) for name in normalize.DETAILS]
    )


def test_fixture_details_from_one_response(spark, tmp_path):
    rows = normalize.entries(raw.read_responses(spark, land(tmp_path, "f", [FULL, BARE]), schemas.response(schemas.FIXTURE)))
    listed = normalize.fixtures(rows.withColumns({"season_start": F.lit(1999), "league_id": F.lit(1)})).collect()
    assert {(r["fixture_id"], r["season_start"], r["league_id"], r["kickoff_at"]) for r in listed} == {
        (9, 2023, 136, dt.datetime(2024, 2, 10, 13, 30)), (10, 2023, 136, dt.datetime(2024, 2, 11, 13, 30)),
    }
    details = normalize.fixture_details(rows, no_details(spark, rows))
    modes = {r["fixture_id"]: r["source_mode"] for r in details.collect()}
    assert modes[9] == "embedded" and modes.get(10) != "embedded"
    details = details.filter("fixture_id = 9")
    events = sorted((r["event_index"], r["elapsed"], r["elapsed_extra"], r["api_player_id"], r["assist_player_id"]) for r in normalize.fixture_events(details).collect())
    assert events == [(0, 12, None, 51, None), (1, 90, 4, 43, None), (2, 90, 5, 44, 43)]
    lineups = {r["api_player_id"]: (r["team_id"], r["lineup_type"], r["shirt_number"], r["grid"]) for r in normalize.fixture_lineups(details).collect()}
    assert lineups[43] == (301, "starter", 17, "3:4") and lineups[41] == (301, "starter", 1, "1:1")
    assert lineups[51] == (302, "starter", None, None) and lineups[42][:2] == (301, "substitute")
    assert lineups[44][1] == "substitute" and len(lineups) == 5
    stats = {r["team_id"]: r for r in normalize.team_statistics(details).collect()}
    assert (stats[301]["ball_possession"], stats[301]["offsides"], stats[301]["yellow_cards"]) == (41.0, 1, None)
    assert (stats[302]["corner_kicks"], stats[302]["pass_accuracy"], stats[302]["ball_possession"]) == (3, None, None)
    players = {r["api_player_id"]: r for r in normalize.player_matches(details).collect()}
    assert (players[43]["minutes"], players[43]["rating"], players[43]["pass_accuracy"], players[43]["captain"]) == (88, None, 74.0, True)
    assert (players[41]["rating"], players[41]["goals"], players[41]["penalties_committed"]) == (6.25, None, None)
    assert players[51]["minutes"] is None and players[51]["player_name"] == "Rivale"


def test_fixture_details_from_separate_responses(spark, tmp_path):
    schema = schemas.response(schemas.FIXTURE)
    read = lambda name, response: normalize.entries(raw.read_responses(spark, land(tmp_path, name, response), schema))
    separate = read("d", [FULL]).select(F.lit(10).alias("fixture_id"), *normalize.DETAILS)
    details = normalize.fixture_details(read("f", [BARE]), separate)
    assert [(r["fixture_id"], r["source_mode"]) for r in details.collect()] == [(10, "per_fixture")]
    assert {r["fixture_id"] for r in normalize.player_matches(details).collect()} == {10}
    # A list that is missing means that the match is not embedded.
    for name in LISTS:
        partial = {**BARE, **{k: v for k, v in LISTS.items() if k != name}}
        assert normalize.fixture_details(read(f"p{name}", [partial]), separate).first()["source_mode"] == "per_fixture"


def test_transfers_and_sidelined_load_twice(spark, tmp_path):
    move = lambda date, into, out, kind="Loan": {"date": date, "type": kind, "teams": {"in": into, "out": out}}
    alba, rocca = {"id": 301, "name": "Alba"}, {"id": 302, "name": "Rocca"}
    transfer = {
        "player": {"id": 43, "name": "Ala"}, "update": "2024-02-02",
        "transfers": [
            move("2024-01-15", alba, rocca), move(None, alba, rocca), move("2023-07-01", {"id": None, "name": None}, rocca),
            move("2024-01-15", {"id": 301, "name": "Alba 1909"}, rocca),
        ],
    }
    rows = normalize.entries(raw.read_responses(spark, land(tmp_path, "t", [transfer]), schemas.response(schemas.TRANSFER)))
    moved = normalize.transfers(rows)
    assert [(r["transfer_date"], r["team_in_name"]) for r in moved.collect()] == [(dt.date(2024, 1, 15), "Alba 1909")]
    twice = upsert.upsert(moved, moved, schemas.KEYS["api_player_transfers"], ["provider_updated_at"])
    assert twice.count() == 1
    spell = lambda kind, start, end=None: {"type": kind, "start": start, "end": end}
    episode = {"id": 43, "sidelined": [spell("Unknown", None), spell("Ankle", "2024-03-05")]}
    rows = normalize.entries(raw.read_responses(spark, land(tmp_path, "s", [episode]), schemas.response(schemas.SIDELINED)))
    out = normalize.sidelined(rows)
    found = out.collect()
    assert len(found) == 1 and found[0]["end_date"] is None
    import hashlib
    assert found[0]["episode_id"] == hashlib.sha256(b"43|Ankle|2024-03-05|").hexdigest()
    assert upsert.upsert(out, out, ["episode_id"], ["start_date"]).count() == 1


def test_player_seasons_squads_profiles_injuries(spark, tmp_path):
    season = lambda league, club, **games: {"league": {"id": league}, "team": {"id": club, "name": "Alba"}, "games": games}
    entry = {
        "player": {"id": 43, "name": "Ala", "nationality": "Malta", "birth": {"date": "2001-11-30"}},
        "statistics": [season(None, 301), season(136, 301, appearences=12, minutes=705, rating="6.05"), season(140, None)],
    }
    rows = normalize.entries(raw.read_responses(spark, land(tmp_path, "ps", [entry]), schemas.response(schemas.PLAYER_SEASON)))
    seasons = normalize.player_seasons(rows.withColumn("season_start", F.lit(2025))).collect()
    assert [(r["league_id"], r["appearances"], r["minutes"], r["rating"], r["goals"]) for r in seasons] == [(136, 12, 705, 6.05, None)]
    squad = [{"players": [{"id": 1, "name": "A", "age": 20, "number": None, "position": "G"}]},
             {"team": {"id": 11, "name": "Own"}, "players": [{"id": 2, "name": "B"}]}]
    rows = normalize.entries(raw.read_responses(spark, land(tmp_path, "sq", squad), schemas.response(schemas.SQUAD)))
    rows = rows.withColumns({"season_start": F.lit(2026), "requested_team_id": F.lit("10"), "requested_team_name": F.lit("Asked")})
    assert sorted((r["api_player_id"], r["team_id"], r["team_name"]) for r in normalize.squads(rows).collect()) == [(1, 10, "Asked"), (2, 11, "Own")]
    profile = [{"player": {"id": 5, "name": "In", "birth": {"date": "2000-01-01"}}}, {"id": 6, "name": "Out"}]
    rows = normalize.entries(raw.read_responses(spark, land(tmp_path, "pr", profile), schemas.response(schemas.PROFILE)))
    assert sorted((r["api_player_id"], r["player_name"]) for r in normalize.profiles(rows).collect()) == [(5, "In"), (6, "Out")]
    injury = [{"player": {"id": 1, "name": "A", "type": "Missing", "reason": "Knee"}, "team": {"id": 2}, "fixture": {"id": 3, "date": "2025-09-01T10:00:00+00:00"}}]
    rows = normalize.entries(raw.read_responses(spark, land(tmp_path, "in", injury), schemas.response(schemas.INJURY)))
    got = normalize.injuries(rows.withColumn("season_start", F.lit(2025))).first()
    assert (got["league_id"], got["reason"], got["team_name"]) == (135, "Knee", "")


def test_raw_index_is_stable_and_ignores_repeats(spark, tmp_path):
    folder = land(tmp_path, "r", [{"b": 1, "a": "é"}])
    bodies = raw.read_bodies(spark, folder)
    requests = bodies.select(F.lit("/x").alias("endpoint"), F.lit('{"season": 2025, "league": 135}').alias("params"), "body", "cache_path")
    rows = raw.index_rows(requests)
    row = rows.first()
    import hashlib
    body = {"results": 1, "paging": {"current": 1, "total": 2}, "response": [{"b": 1, "a": "é"}]}
    stable = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    sha = hashlib.sha256(stable(body).encode()).hexdigest()
    assert row["payload_sha256"] == sha
    expected = hashlib.sha256(f"/x:{stable({'season': 2025, 'league': 135, 'payload_sha': sha})}".encode()).hexdigest()
    assert row["response_id"] == expected
    assert (row["result_count"], row["page"], row["total_pages"]) == (1, 1, 2)
    assert raw.add_to_index(rows, rows).count() == 1
    joined = raw.read_responses(spark, folder, schemas.response(schemas.SIDELINED), rows)
    assert joined.first()["endpoint"] == "/x"


def test_fixture_plan_and_scope(spark):
    fixtures = spark.createDataFrame(
        [(1, "FT", 10, 20), (2, "NS", 10, 20), (3, "FT", 30, 40), (4, "AET", 40, 10)],
        "fixture_id int, status_short string, home_team_id int, away_team_id int",
    )
    ledger = spark.createDataFrame([(1, "complete"), (4, "incomplete")], "fixture_id int, status string")
    teams = spark.createDataFrame([(10,)], "team_id int")
    ids = lambda df: sorted(r["fixture_id"] for r in df.collect())
    assert ids(upsert.fixture_plan(fixtures, ledger)) == [3, 4]
    assert ids(upsert.fixture_plan(fixtures, ledger, teams=teams)) == [4]
    assert ids(upsert.fixture_plan(fixtures, ledger, refresh=True)) == [1, 3, 4]
    none = spark.createDataFrame([(999,)], "team_id int")
    assert ids(upsert.fixture_plan(fixtures, ledger, teams=none)) == []
