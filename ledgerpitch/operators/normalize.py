"""Nested provider responses as keyed tables.

Every function takes entries (one row per element of ``response``) and gives typed rows. Lists are
exploded with their position, so that the first or last row of a key is well defined; picking it
only compares rows of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpitch.functions.casts import blank_to_null, to_bool, to_date, to_double, to_int, to_number
from ledgerpitch.functions.hashing import content_id
from ledgerpitch.operators.latest import first_rows

Cast = Callable[[Column], Column]
LEAGUE = 135

# Names of the team statistics at the provider.
TEAM_STATISTICS = {
    "Shots on Goal": "shots_on_goal",
    "Shots off Goal": "shots_off_goal",
    "Shots insidebox": "shots_inside_box",
    "Shots outsidebox": "shots_outside_box",
    "Total Shots": "total_shots",
    "Blocked Shots": "blocked_shots",
    "Fouls": "fouls",
    "Corner Kicks": "corner_kicks",
    "Offsides": "offsides",
    "Ball Possession": "ball_possession",
    "Yellow Cards": "yellow_cards",
    "Red Cards": "red_cards",
    "Goalkeeper Saves": "goalkeeper_saves",
    "Total passes": "total_passes",
    "Passes accurate": "passes_accurate",
    "Passes %": "pass_accuracy",
}
PERCENTAGES = ("ball_possession", "pass_accuracy")


def entries(responses: DataFrame, *kept: str) -> DataFrame:
    """One row per element of the ``response`` list, with the wanted request columns."""
    return responses.select(*kept, F.explode("response").alias("entry")).select(*kept, "entry.*")


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _columns(paths: Mapping[str, tuple[str, Cast | None]], prefix: str = "") -> list[Column]:
    found = []
    for name, (path, cast) in paths.items():
        column = F.col(f"{prefix}{path}")
        found.append((cast(column) if cast else column).alias(name))
    return found


def _present(value: Column) -> Column:
    """Ids that are missing, blank or zero do not identify anything."""
    return F.coalesce(~blank_to_null(value).isin("0"), F.lit(False))


def player_seasons(rows: DataFrame, season: str = "season_start") -> DataFrame:
    flat = rows.select(season, "player", F.explode("statistics").alias("s")).filter(
        _present(F.col("s.league.id")) & _present(F.col("s.team.id"))
    )
    return flat.select(
        *_columns({"api_player_id": ("player.id", to_int)}),
        F.col(season).alias("season_start"),
        *_columns(
            {
                "league_id": ("league.id", to_int),
                "team_id": ("team.id", to_int),
            },
            "s.",
        ),
        *_columns({"player_name": ("player.name", None)}),
        *_columns({"team_name": ("team.name", None)}, "s."),
        *_columns({"birth_date": ("player.birth.date", to_date), "nationality": ("player.nationality", None)}),
        *_columns(
            {
                "position": ("games.position", None),
                "appearances": ("games.appearences", to_int),
                "lineups": ("games.lineups", to_int),
                "minutes": ("games.minutes", to_int),
                "rating": ("games.rating", to_double),
                "goals": ("goals.total", to_int),
                "assists": ("goals.assists", to_int),
                "shots": ("shots.total", to_int),
                "shots_on": ("shots.on", to_int),
                "yellow_cards": ("cards.yellow", to_int),
                "red_cards": ("cards.red", to_int),
                "penalties_scored": ("penalty.scored", to_int),
                "penalties_missed": ("penalty.missed", to_int),
                "goals_conceded": ("goals.conceded", to_int),
                "saves": ("goals.saves", to_int),
            },
            "s.",
        ),
    )


def injuries(rows: DataFrame, season: str = "season_start") -> DataFrame:
    return rows.select(
        *_columns({"api_player_id": ("player.id", to_int)}),
        F.col(season).alias("season_start"),
        F.when(_present(F.col("league.id")), to_int(F.col("league.id"))).otherwise(LEAGUE).alias("league_id"),
        *_columns(
            {
                "team_id": ("team.id", to_int),
                "fixture_id": ("fixture.id", to_int),
                "player_name": ("player.name", text),
                "team_name": ("team.name", text),
                "injury_type": ("player.type", None),
                "reason": ("player.reason", None),
                "fixture_date": ("fixture.date", lambda c: blank_to_null(c).try_cast("timestamp")),
            }
        ),
    )


def squads(rows: DataFrame, season: str = "season_start") -> DataFrame:
    """Squad players; a squad without its own team takes the requested one."""
    return (
        rows.select(
            season,
            F.coalesce("team", F.struct(F.col("requested_team_id").alias("id"), F.col("requested_team_name").alias("name"))).alias("team"),
            F.explode("players").alias("p"),
        )
        .select(
            *_columns({"api_player_id": ("p.id", to_int)}),
            F.col(season).alias("season_start"),
            *_columns(
                {
                    "team_id": ("team.id", to_int),
                    "player_name": ("p.name", text),
                    "team_name": ("team.name", text),
                    "age": ("p.age", to_int),
                    "number": ("p.number", to_int),
                    "position": ("p.position", None),
                }
            ),
        )
    )


def profiles(rows: DataFrame) -> DataFrame:
    """Profiles, whether the entry is the player or holds it."""

    def either(name: str) -> Column:
        return F.when(F.col("player").isNotNull(), F.col(f"player.{name}")).otherwise(F.col(name))

    return rows.select(
        to_int(either("id")).alias("api_player_id"),
        text(either("name")).alias("player_name"),
        *[either(name).alias(name) for name in ("firstname", "lastname")],
        to_date(either("birth.date")).alias("birth_date"),
        *[either(name).alias(name) for name in ("nationality", "height", "weight")],
    )


def fixtures(rows: DataFrame, season: str = "season_start", league: str = "league_id") -> DataFrame:
    def or_requested(path: str, requested: str) -> Column:
        return F.when(_present(F.col(path)), to_int(F.col(path))).otherwise(F.col(requested))

    return rows.select(
        to_int(F.col("fixture.id")).alias("fixture_id"),
        or_requested("league.id", league).alias("league_id"),
        or_requested("league.season", season).alias("season_start"),
        *_columns(
            {
                "round": ("league.round", None),
                "kickoff_at": ("fixture.date", lambda c: blank_to_null(c).try_cast("timestamp")),
                "timezone": ("fixture.timezone", None),
                "status_short": ("fixture.status.short", None),
                "elapsed": ("fixture.status.elapsed", to_int),
                "referee": ("fixture.referee", None),
                "venue_id": ("fixture.venue.id", to_int),
                "venue_name": ("fixture.venue.name", None),
                "venue_city": ("fixture.venue.city", None),
                "home_team_id": ("teams.home.id", to_int),
                "home_team_name": ("teams.home.name", text),
                "away_team_id": ("teams.away.id", to_int),
                "away_team_name": ("teams.away.name", text),
                "home_goals": ("goals.home", to_int),
                "away_goals": ("goals.away", to_int),
                "halftime_home": ("score.halftime.home", to_int),
                "halftime_away": ("score.halftime.away", to_int),
                "fulltime_home": ("score.fulltime.home", to_int),
                "fulltime_away": ("score.fulltime.away", to_int),
            }
        ),
    )


DETAILS = ("events", "lineups", "statistics", "players")


def fixture_details(embedded: DataFrame, separate: DataFrame) -> DataFrame:
    """Detail lists per fixture: all four embedded lists, else those of the separate responses.

    ``separate`` has one row per fixture with the same four list columns.
    """
    complete = F.lit(True)
    for name in DETAILS:
        complete = complete & F.col(name).isNotNull()
    own = embedded.select(
        to_int(F.col("fixture.id")).alias("fixture_id"),
        complete.alias("_complete"),
        # Lists of which one is missing are never taken, so they do not travel to the join.
        *[F.when(complete, F.col(name)).alias(f"_own_{name}") for name in DETAILS],
    )
    return own.join(separate, "fixture_id", "left").select(
        "fixture_id",
        *[
            F.when(F.col("_complete"), F.col(f"_own_{name}")).otherwise(F.col(name)).alias(name)
            for name in DETAILS
        ],
        F.when(F.col("_complete"), "embedded").otherwise("per_fixture").alias("source_mode"),
    )


def fixture_events(details: DataFrame) -> DataFrame:
    return details.select("fixture_id", F.posexplode("events").alias("event_index", "e")).select(
        "fixture_id",
        "event_index",
        *_columns(
            {
                "elapsed": ("time.elapsed", to_int),
                "elapsed_extra": ("time.extra", to_int),
                "team_id": ("team.id", to_int),
                "api_player_id": ("player.id", to_int),
                "player_name": ("player.name", None),
                "assist_player_id": ("assist.id", to_int),
                "assist_player_name": ("assist.name", None),
                "event_type": ("type", None),
                "detail": ("detail", None),
                "comments": ("comments", None),
            },
            "e.",
        ),
    )


def fixture_lineups(details: DataFrame) -> DataFrame:
    """Line-ups; starters come before substitutes, and the first row of a key stands."""

    def tagged(list_name: str, kind: str, rank: int) -> Column:
        empty = F.array().cast("array<struct<kind:string,rank:int,player:struct<id:string,name:string,number:string,pos:string,grid:string>>>")
        return F.coalesce(
            F.transform(
                F.col(f"l.{list_name}"),
                lambda item: F.struct(
                    F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), item["player"].alias("player")
                ),
            ),
            empty,
        )

    flat = (
        details.select("fixture_id", F.posexplode("lineups").alias("_entry", "l"))
        .select(
            "fixture_id",
            "_entry",
            "l",
            F.posexplode(
                F.concat(tagged("startXI", "starter", 0), tagged("substitutes", "substitute", 1))
            ).alias("_place", "item"),
        )
        .filter(_present(F.col("item.player.id")))
        .select(
            "fixture_id",
            to_int(F.col("l.team.id")).alias("team_id"),
            to_int(F.col("item.player.id")).alias("api_player_id"),
            text(F.col("item.player.name")).alias("player_name"),
            F.col("item.kind").alias("lineup_type"),
            F.col("item.player.pos").alias("position"),
            F.col("item.player.grid").alias("grid"),
            to_int(F.col("item.player.number")).alias("shirt_number"),
            F.col("l.formation").alias("formation"),
            to_int(F.col("l.coach.id")).alias("coach_id"),
            F.col("l.coach.name").alias("coach_name"),
            "_entry",
            "_place",
        )
    )
    return first_rows(
        flat, ["fixture_id", "team_id", "api_player_id"], [F.col("_entry"), F.col("_place")]
    ).drop("_entry", "_place")


def pivot_pairs(pairs: Column, names: Mapping[str, str], percentages: Sequence[str] = ()) -> list[Column]:
    """Typed columns from a list of ``{type, value}``; the last of equal types wins.

    Unknown types are ignored; whole numbers lose their fraction.
    """

    def last_value(label: str) -> Column:
        matching = F.filter(pairs, lambda pair: pair["type"] == label)
        return F.try_element_at(matching, F.lit(-1))["value"]

    columns = []
    for label, name in names.items():
        number = to_number(last_value(label))
        columns.append((number if name in percentages else number.cast("int")).alias(name))
    return columns


def team_statistics(details: DataFrame) -> DataFrame:
    return (
        details.select("fixture_id", F.explode("statistics").alias("t"))
        .filter(_present(F.col("t.team.id")))
        .select(
            "fixture_id",
            to_int(F.col("t.team.id")).alias("team_id"),
            *pivot_pairs(F.col("t.statistics"), TEAM_STATISTICS, PERCENTAGES),
        )
    )


def player_matches(details: DataFrame) -> DataFrame:
    """Player statistics of a fixture; the first row of a key stands."""
    flat = (
        details.select("fixture_id", F.posexplode("players").alias("_entry", "t"))
        .filter(_present(F.col("t.team.id")))
        .select("fixture_id", "_entry", "t.team", F.posexplode("t.players").alias("_place", "p"))
        .filter(_present(F.col("p.player.id")))
        .withColumn("s", F.get("p.statistics", 0))
    )
    wanted = {
        "position": ("games.position", None),
        "minutes": ("games.minutes", to_int),
        "rating": ("games.rating", to_double),
        "captain": ("games.captain", to_bool),
        "substitute": ("games.substitute", to_bool),
        "shots": ("shots.total", to_int),
        "shots_on": ("shots.on", to_int),
        "goals": ("goals.total", to_int),
        "goals_conceded": ("goals.conceded", to_int),
        "assists": ("goals.assists", to_int),
        "saves": ("goals.saves", to_int),
        "passes": ("passes.total", to_int),
        "key_passes": ("passes.key", to_int),
        "pass_accuracy": ("passes.accuracy", to_number),
        "tackles": ("tackles.total", to_int),
        "blocks": ("tackles.blocks", to_int),
        "interceptions": ("tackles.interceptions", to_int),
        "duels": ("duels.total", to_int),
        "duels_won": ("duels.won", to_int),
        "dribbles_attempts": ("dribbles.attempts", to_int),
        "dribbles_success": ("dribbles.success", to_int),
        "dribbled_past": ("dribbles.past", to_int),
        "fouls_drawn": ("fouls.drawn", to_int),
        "fouls_committed": ("fouls.committed", to_int),
        "yellow_cards": ("cards.yellow", to_int),
        "red_cards": ("cards.red", to_int),
        "penalties_won": ("penalty.won", to_int),
        "penalties_committed": ("penalty.commited", to_int),
        "penalties_scored": ("penalty.scored", to_int),
        "penalties_missed": ("penalty.missed", to_int),
        "penalties_saved": ("penalty.saved", to_int),
    }
    keyed = flat.select(
        "fixture_id",
        to_int(F.col("team.id")).alias("team_id"),
        to_int(F.col("p.player.id")).alias("api_player_id"),
        text(F.col("p.player.name")).alias("player_name"),
        *_columns(wanted, "s."),
        "_entry",
        "_place",
    )
    return first_rows(
        keyed, ["fixture_id", "team_id", "api_player_id"], [F.col("_entry"), F.col("_place")]
    ).drop("_entry", "_place")


def transfers(rows: DataFrame, sequence: Sequence[str] = ()) -> DataFrame:
    """Transfers with date and both clubs; the last row of a five-part key stands.

    ``sequence`` names columns that order the entries, such as the position in the response.
    """
    flat = (
        rows.filter(_present(F.col("player.id")))
        .select("player", "update", *sequence, F.posexplode("transfers").alias("_place", "t"))
        .filter(
            blank_to_null(F.col("t.date")).isNotNull()
            & _present(F.col("t.teams.in.id"))
            & _present(F.col("t.teams.out.id"))
        )
        .select(
            *_columns(
                {
                    "api_player_id": ("player.id", to_int),
                    "player_name": ("player.name", text),
                    "transfer_date": ("t.date", to_date),
                    "transfer_type": ("t.type", lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))),
                    "team_in_id": ("t.teams.in.id", to_int),
                    "team_in_name": ("t.teams.in.name", text),
                    "team_out_id": ("t.teams.out.id", to_int),
                    "team_out_name": ("t.teams.out.name", text),
                    "provider_updated_at": ("update", None),
                }
            ),
            *sequence,
            "_place",
        )
    )
    key = ["api_player_id", "transfer_date", "transfer_type", "team_in_id", "team_out_id"]
    newest = [F.col(name).desc() for name in (*sequence, "_place")]
    return first_rows(flat, key, newest).drop(*sequence, "_place")


def sidelined(rows: DataFrame) -> DataFrame:
    """Sidelined episodes with a content id; open episodes have no end."""
    flat = rows.filter(blank_to_null(F.col("id")).isNotNull()).select(
        to_int(F.col("id")).alias("api_player_id"), F.explode("sidelined").alias("e")
    ).filter(blank_to_null(F.col("e.start")).isNotNull())
    kind = F.coalesce(F.nullif(F.col("e.type"), F.lit("")), F.lit("unknown"))
    return flat.select(
        content_id(F.col("api_player_id"), kind, F.col("e.start"), F.col("e.end")).alias("episode_id"),
        "api_player_id",
        kind.alias("sidelined_type"),
        to_date(F.col("e.start")).alias("start_date"),
        to_date(F.col("e.end")).alias("end_date"),
    )
