"""Checks that must hold before a build, and the sets they are computed from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINIMUM_ACTIVE = 250


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def variants(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that occur with more than one value."""
    return (
        df.groupBy(key)
        .agg(F.countDistinct(value).alias("variants"))
        .filter(F.col("variants") > 1)
    )


def undecided(players: DataFrame, mappings: DataFrame) -> DataFrame:
    """Active players without an accepted or excluded decision in their season."""
    decided = mappings.filter(F.col("status").isin("accepted", "excluded"))
    return players.filter(F.col("status") == "active").join(
        decided, ["season", "fantacalcio_id"], "left_anti"
    )


def search_gaps(players: DataFrame, mappings: DataFrame, season: str) -> DataFrame:
    """Active players with neither an accepted nor a pending link."""
    links = mappings.filter(F.col("season") == season).select(
        "fantacalcio_id", F.col("status").alias("link_status")
    )
    return (
        players.filter((F.col("season") == season) & (F.col("status") == "active"))
        .join(links, "fantacalcio_id", "left")
        .groupBy("fantacalcio_id", "name")
        .agg(
            F.count_if(F.col("link_status") == "accepted").alias("accepted"),
            F.count_if(F.col("link_status") == "pending").alias("pending"),
        )
        .filter((F.col("accepted") == 0) & (F.col("pending") == 0))
        .select("fantacalcio_id", "name")
    )


def require_none(df: DataFrame, message: str) -> None:
    found = df.count()
    if found:
        raise ValueError(f"{message}: {found}")


def require_pool(players: DataFrame, season: str, minimum: int = MINIMUM_ACTIVE) -> int:
    active = players.filter((F.col("season") == season) & (F.col("status") == "active")).count()
    if active < minimum:
        raise ValueError(f"active pool too small for {season}: {active}")
    return active


def require_decisions(
    players: DataFrame, mappings: DataFrame, squads: DataFrame, season_stats: DataFrame, season: str
) -> None:
    """With provider rows for the season every active player needs a decision."""
    start = int(season.split("/")[0])
    loaded = (
        squads.filter(F.col("season_start") == start)
        .select("api_player_id")
        .unionByName(season_stats.filter(F.col("season_start") == start).select("api_player_id"))
    )
    if loaded.isEmpty():
        return
    require_none(
        undecided(players.filter(F.col("season") == season), mappings),
        "active players without an accepted or excluded link",
    )


def cohort(*sources: DataFrame, key: str = "api_player_id") -> DataFrame:
    """Distinct ids over several sources."""
    union = sources[0].select(key)
    for source in sources[1:]:
        union = union.unionByName(source.select(key))
    return union.distinct()


def current_cohort(squads: DataFrame, season_start: int) -> DataFrame:
    return cohort(squads.filter(F.col("season_start") == season_start))


def five_year_cohort(
    season_stats: DataFrame,
    squads: DataFrame,
    mappings: DataFrame,
    season_start: int,
    first: int,
    last: int,
    league_id: int = 135,
) -> DataFrame:
    return cohort(
        season_stats.filter(
            (F.col("league_id") == league_id) & F.col("season_start").between(first, last)
        ),
        squads.filter(F.col("season_start") == season_start),
        mappings.filter((F.col("status") == "accepted") & (F.col("api_player_id") > 0)),
    )


def complete_loads(rows: DataFrame, loads: DataFrame, backfills: DataFrame) -> DataFrame:
    """Rows whose (season, league) load or (player, season) backfill is complete.

    Both sides are reduced to distinct keys, so a key is matched once however often it was loaded.
    """
    by_league = (
        loads.filter((F.col("endpoint") == "/players") & (F.col("status") == "complete"))
        .select("season_start", "league_id")
        .distinct()
        .withColumn("_league_done", F.lit(True))
    )
    by_player = (
        backfills.filter(F.col("status") == "complete")
        .select("api_player_id", "season_start")
        .distinct()
        .withColumn("_player_done", F.lit(True))
    )
    return (
        rows.join(by_league, ["season_start", "league_id"], "left")
        .join(by_player, ["api_player_id", "season_start"], "left")
        .filter(F.col("_league_done").isNotNull() | F.col("_player_done").isNotNull())
        .select(*rows.columns)
    )


def within(value: Column, low: float, high: float) -> Column:
    return value.isNull() | value.between(low, high)
