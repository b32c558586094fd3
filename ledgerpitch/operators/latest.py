"""Best or newest rows per key.

``row_number() <= n`` lets Spark keep only n rows per key in every map task before the shuffle,
so a key with a third of all rows still sends n rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int = 1,
    place: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of every key, optionally with their place."""
    name = place or "_place"
    ranked = df.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(name) <= n)
    return ranked if place else ranked.drop(name)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    return first_rows(
        snapshots,
        ["season"],
        [
            F.col("source_modified_at").desc_nulls_last(),
            F.col("imported_at").desc_nulls_last(),
            F.col("snapshot_id").asc(),
        ],
    )


def latest_players(players: DataFrame, snapshots: DataFrame) -> DataFrame:
    newest = latest_snapshots(snapshots).select("snapshot_id", "season")
    return players.join(newest, ["snapshot_id", "season"])


def season_summary(snapshots: DataFrame) -> DataFrame:
    return latest_snapshots(snapshots).select(
        "season", "snapshot_id", "record_count", "active_count", "ceduti_count", "source_modified_at"
    )


def valid_at(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows whose validity interval holds the date; an open end is null."""
    return df.filter(
        (F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of))
    )


def current_overrides(overrides: DataFrame, season: str, as_of: Column) -> DataFrame:
    live = valid_at(overrides.filter(F.col("season") == season), as_of)
    return first_rows(live, ["fantacalcio_id"], [F.col("valid_from").desc()])


def candidate_pool(
    season_stats: DataFrame,
    squads: DataFrame,
    profiles: DataFrame,
    season_start: int,
    league_id: int = 135,
    years_back: int = 5,
) -> DataFrame:
    """One row per provider player: current league, squad, earlier seasons, then profiles."""
    played = season_stats.select(
        "api_player_id",
        "player_name",
        "team_name",
        F.coalesce("minutes", F.lit(0)).cast("long").alias("minutes"),
        "season_start",
        "league_id",
    )
    sources = (
        played.filter((F.col("season_start") == season_start) & (F.col("league_id") == league_id))
        .withColumn("priority", F.lit(1))
        .drop("season_start", "league_id")
    )
    squad = squads.filter(F.col("season_start") == season_start).select(
        "api_player_id",
        "player_name",
        "team_name",
        F.lit(0).cast("long").alias("minutes"),
        F.lit(0).alias("priority"),
    )
    earlier = (
        played.filter(F.col("season_start").between(season_start - years_back, season_start - 1))
        .withColumn("priority", (F.col("season_start") - season_start).cast("int"))
        .drop("season_start", "league_id")
    )
    searched = profiles.select(
        "api_player_id",
        "player_name",
        F.lit("").alias("team_name"),
        F.lit(0).cast("long").alias("minutes"),
        F.lit(-10).alias("priority"),
    )
    return prioritised(
        sources.unionByName(squad).unionByName(earlier).unionByName(searched)
    )


def prioritised(rows: DataFrame) -> DataFrame:
    """Best source per provider player: priority, then minutes, then team name."""
    return first_rows(
        rows,
        ["api_player_id"],
        [
            F.col("priority").desc_nulls_last(),
            F.col("minutes").desc_nulls_last(),
            F.col("team_name").asc_nulls_last(),
            F.col("player_name").asc_nulls_last(),
        ],
    )


def pending_rows(
    mappings: DataFrame, players: DataFrame, season_stats: DataFrame, squads: DataFrame
) -> DataFrame:
    """Pending links with the provider's name: season statistics first, then squads."""
    season_of = F.split_part("season", F.lit("/"), F.lit(1)).cast("int")
    pending = mappings.filter(F.col("status") == "pending").withColumn("season_start", season_of)
    listed = players.select("season", "fantacalcio_id", "name", "team")
    # The best pair is the best statistics row with the best squad row, so each side is reduced
    # before the join and pairs are never spelled out.
    links = ["api_player_id", "season_start"]
    stats = first_rows(
        season_stats.select(
            *links,
            F.col("player_name").alias("stats_name"),
            F.col("team_name").alias("stats_team"),
            "minutes",
        ),
        links,
        [
            F.col("minutes").desc_nulls_last(),
            F.col("stats_team").asc_nulls_last(),
            F.col("stats_name").asc_nulls_last(),
        ],
    )
    squad = first_rows(
        squads.select(
            *links,
            F.col("player_name").alias("squad_name"),
            F.col("team_name").alias("squad_team"),
        ),
        links,
        [F.col("squad_team").asc_nulls_last(), F.col("squad_name").asc_nulls_last()],
    )
    joined = (
        pending.join(listed, ["season", "fantacalcio_id"])
        .join(stats, links, "left")
        .join(squad, links, "left")
    )
    best = first_rows(
        joined,
        ["season", "fantacalcio_id"],
        [
            F.col("minutes").desc_nulls_last(),
            F.col("squad_team").asc_nulls_last(),
            F.col("api_player_id").asc(),
        ],
    )
    return best.select(
        "season",
        "fantacalcio_id",
        F.col("name").alias("fantacalcio_name"),
        F.col("team").alias("fantacalcio_team"),
        "api_player_id",
        F.coalesce("stats_name", "squad_name").alias("api_name"),
        F.coalesce("stats_team", "squad_team").alias("api_team"),
        "confidence",
        "method",
    )


def newest_before(df: DataFrame, at: str, limit: Column, order: Sequence[Column]) -> DataFrame:
    """The single newest row before a date."""
    return df.filter(F.col(at) < limit).orderBy(F.col(at).desc(), *order).limit(1)


def previous_build(builds: DataFrame, season: str, as_of: Column) -> DataFrame:
    return newest_before(
        builds.filter(F.col("season") == season),
        "as_of",
        as_of,
        [F.col("created_at").desc(), F.col("build_id")],
    )
