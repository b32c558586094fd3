"""Declared schemas of provider responses and the keys of the stored tables.

Leaves of responses are text, because the provider mixes numbers, numbers in quotes and percent
values; the casts of the normalisers decide.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Primary keys of the stored tables.
KEYS = {
    "listone_snapshots": ("snapshot_id",),
    "listone_players": ("snapshot_id", "fantacalcio_id"),
    "api_raw_responses": ("response_id",),
    "api_player_season_stats": ("api_player_id", "season_start", "league_id", "team_id"),
    "api_ingestion_status": ("endpoint", "season_start", "league_id"),
    "api_player_backfills": ("api_player_id", "season_start"),
    "api_player_profiles": ("api_player_id",),
    "api_player_transfers": ("api_player_id", "transfer_date", "transfer_type", "team_in_id", "team_out_id"),
    "api_player_sidelined": ("episode_id",),
    "api_injuries": ("api_player_id", "season_start", "fixture_id"),
    "api_squad_players": ("api_player_id", "season_start", "team_id"),
    "api_fixtures": ("fixture_id",),
    "api_player_fixture_stats": ("fixture_id", "team_id", "api_player_id"),
    "api_fixture_lineups": ("fixture_id", "team_id", "api_player_id"),
    "api_fixture_events": ("fixture_id", "event_index"),
    "api_fixture_team_stats": ("fixture_id", "team_id"),
    "api_fixture_ingestion_status": ("fixture_id",),
    "ml_player_fixture_features": ("fixture_id", "api_player_id"),
    "provider_player_mappings": ("fantacalcio_id", "api_player_id", "season"),
    "curated_overrides": ("fantacalcio_id", "season", "valid_from"),
    "build_snapshots": ("build_id",),
    "auction_values": ("build_id", "fantacalcio_id"),
}


def record(**fields: T.DataType | str) -> T.StructType:
    """A struct; every string names a text field or, for ``"a b c"``, a record of text fields."""

    def kind(value: T.DataType | str) -> T.DataType:
        if isinstance(value, T.DataType):
            return value
        return T.StructType([T.StructField(name, T.StringType()) for name in value.split()])

    return T.StructType([T.StructField(name, kind(value)) for name, value in fields.items()])


TEXT = T.StringType()
NAMED = record(id=TEXT, name=TEXT)


def many(value: T.DataType) -> T.ArrayType:
    return T.ArrayType(value)


def response(entry: T.StructType) -> T.StructType:
    return record(results=TEXT, paging="current total", response=many(entry))


PLAYER_SEASON = record(
    player=record(id=TEXT, name=TEXT, nationality=TEXT, birth="date"),
    statistics=many(
        record(
            league="id",
            team="id name",
            games="position appearences lineups minutes rating",
            goals="total assists conceded saves",
            shots="total on",
            cards="yellow red",
            penalty="scored missed",
        )
    ),
)
INJURY = record(player="id name type reason", team="id name", fixture="id date", league="id")
SQUAD = record(team="id name", players=many(record(id=TEXT, name=TEXT, age=TEXT, number=TEXT, position=TEXT)))
_PROFILE = dict(
    id=TEXT, name=TEXT, firstname=TEXT, lastname=TEXT, birth="date", nationality=TEXT, height=TEXT, weight=TEXT
)
PROFILE = record(player=record(**_PROFILE), **_PROFILE)
TRANSFER = record(
    player=NAMED,
    update=TEXT,
    transfers=many(record(date=TEXT, type=TEXT, teams=T.StructType([
        T.StructField("in", NAMED), T.StructField("out", NAMED)]))),
)
SIDELINED = record(id=TEXT, sidelined=many(record(type=TEXT, start=TEXT, end=TEXT)))
EVENT = record(
    time="elapsed extra", team="id", player="id name", assist="id name", type=TEXT, detail=TEXT, comments=TEXT
)
_LINED_UP = record(player="id name number pos grid")
LINEUP = record(
    team="id name", formation=TEXT, coach="id name", startXI=many(_LINED_UP), substitutes=many(_LINED_UP)
)
TEAM_STATISTICS = record(team="id name", statistics=many(record(type=TEXT, value=TEXT)))
PLAYER_MATCH = record(
    team="id name",
    players=many(
        record(
            player="id name",
            statistics=many(
                record(
                    games="minutes position rating captain substitute",
                    shots="total on",
                    goals="total conceded assists saves",
                    passes="total key accuracy",
                    tackles="total blocks interceptions",
                    duels="total won",
                    dribbles="attempts success past",
                    fouls="drawn committed",
                    cards="yellow red",
                    penalty="won commited scored missed saved",
                )
            ),
        )
    ),
)
FIXTURE = record(
    fixture=record(
        id=TEXT, date=TEXT, timezone=TEXT, referee=TEXT, venue="id name city", status="short elapsed"
    ),
    league="id season round",
    teams=record(home="id name", away="id name"),
    goals="home away",
    score=record(halftime="home away", fulltime="home away"),
    events=many(EVENT),
    lineups=many(LINEUP),
    statistics=many(TEAM_STATISTICS),
    players=many(PLAYER_MATCH),
)
