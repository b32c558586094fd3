"""Datasets behind the published report: alerts, transfers, coverage, freshness, ranking flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpitch.functions.text import club_key
from ledgerpitch.operators.diff import ADDED, flag
from ledgerpitch.operators.latest import first_rows

# Texts shown when the provider gives no reason, and the windows in days.
INJURED = "Infortunio"
UNAVAILABLE = "Indisponibile"
INJURY_DAYS_BACK = 7
INJURY_DAYS_AHEAD = 45
OPEN_EPISODE_DAYS = 180
TRANSFER_DAYS = 30


def accepted_links(mappings: DataFrame, season: str) -> DataFrame:
    return (
        mappings.filter((F.col("season") == season) & (F.col("status") == "accepted"))
        .select("fantacalcio_id", "api_player_id")
        .distinct()
    )


def injuries_near(injuries: DataFrame, season_start: int, as_of: Column) -> DataFrame:
    day = F.to_date("fixture_date")
    return injuries.filter(
        (F.col("season_start") == season_start)
        & day.between(F.date_sub(as_of, INJURY_DAYS_BACK), F.date_add(as_of, INJURY_DAYS_AHEAD))
    )


def open_episodes(sidelined: DataFrame, as_of: Column) -> DataFrame:
    """Episodes running at the date; one without an end counts for 180 days."""
    return sidelined.filter(
        (F.col("start_date") <= as_of)
        & (
            (F.col("end_date") >= as_of)
            | (
                F.col("end_date").isNull()
                & (F.col("start_date") >= F.date_sub(as_of, OPEN_EPISODE_DAYS))
            )
        )
    )


def unavailable_players(
    links: DataFrame, injuries: DataFrame, sidelined: DataFrame, season_start: int, as_of: Column
) -> DataFrame:
    """Distinct listed players injured or sidelined at the date."""
    hurt = injuries_near(injuries, season_start, as_of).select("api_player_id")
    out = open_episodes(sidelined, as_of).select("api_player_id")
    return (
        links.join(hurt.unionByName(out), "api_player_id", "left_semi")
        .select("fantacalcio_id")
        .distinct()
    )


def signals(
    links: DataFrame, injuries: DataFrame, sidelined: DataFrame, season_start: int, as_of: Column
) -> DataFrame:
    """Newest availability signal per listed player from both sources."""

    def text(*options: Column) -> Column:
        return F.coalesce(*options)

    hurt = (
        injuries_near(injuries, season_start, as_of)
        .join(links, "api_player_id")
        .select(
            "fantacalcio_id",
            text(
                F.nullif(F.col("reason"), F.lit("")),
                F.nullif(F.col("injury_type"), F.lit("")),
                F.lit(INJURED),
            ).alias("detail"),
            F.to_date("fixture_date").alias("start_date"),
            F.col("updated_at").alias("observed_at"),
        )
    )
    out = (
        open_episodes(sidelined, as_of)
        .join(links, "api_player_id")
        .select(
            "fantacalcio_id",
            text(F.nullif(F.col("sidelined_type"), F.lit("")), F.lit(UNAVAILABLE)).alias("detail"),
            "start_date",
            "end_date",
            "observed_at",
        )
    )
    return first_rows(
        hurt.unionByName(out, allowMissingColumns=True),
        ["fantacalcio_id"],
        [
            F.col("start_date").desc_nulls_last(),
            F.col("observed_at").desc_nulls_last(),
            F.col("detail").asc(),
            F.col("end_date").desc_nulls_last(),
        ],
    )


def availability_alerts(ranking: DataFrame, newest_signals: DataFrame) -> DataFrame:
    return ranking.join(newest_signals, "fantacalcio_id").select(
        "fantacalcio_id",
        "name",
        "team",
        "role",
        "suggested_credits",
        "expected_start_share",
        "detail",
        "start_date",
        "end_date",
    )


def verified_transfers(
    ranking: DataFrame, links: DataFrame, transfers: DataFrame, as_of: Column
) -> DataFrame:
    """Newest transfer of the last 30 days, kept where the receiving club is the listed club."""
    recent = transfers.filter(
        F.col("transfer_date").between(F.date_sub(as_of, TRANSFER_DAYS), as_of)
    )
    joined = (
        recent.join(links, "api_player_id")
        .join(
            ranking.select("fantacalcio_id", "name", "team", "role", "suggested_credits"),
            "fantacalcio_id",
        )
        .select(
            "fantacalcio_id",
            "name",
            "team",
            "role",
            "suggested_credits",
            "transfer_date",
            "transfer_type",
            "team_in_name",
            "team_out_name",
            "observed_at",
        )
    )
    newest = first_rows(
        joined,
        ["fantacalcio_id"],
        [
            F.col("transfer_date").desc(),
            F.col("observed_at").desc_nulls_last(),
            F.col("team_in_name").asc(),
            F.col("team_out_name").asc(),
            F.col("transfer_type").asc(),
        ],
    )
    return newest.filter(club_key(F.col("team_in_name")) == club_key(F.col("team"))).drop("observed_at")


def coverage(
    ranking: DataFrame, mappings: DataFrame, squads: DataFrame, season: str, season_start: int
) -> DataFrame:
    """How many ranked players are linked, decided, pending, and seen in the newest squads."""
    decided = mappings.filter(F.col("season") == season)
    per_player = decided.groupBy("fantacalcio_id").agg(
        F.max(F.when(F.col("status") == "accepted", 1).otherwise(0)).alias("accepted"),
        F.max(F.when(F.col("status").isin("accepted", "excluded"), 1).otherwise(0)).alias("decided"),
        F.max(F.when(F.col("status") == "pending", 1).otherwise(0)).alias("pending"),
    )
    current = squads.filter(F.col("season_start") == season_start).withColumn(
        "day", F.to_date("updated_at")
    )
    newest_day = current.select(F.max("day")).scalar()
    confirmed = (
        accepted_links(mappings, season)
        .join(current.filter(F.col("day") == newest_day), "api_player_id", "left_semi")
        .select("fantacalcio_id")
        .distinct()
        .withColumn("confirmed", F.lit(1))
    )
    joined = (
        ranking.select("fantacalcio_id")
        .join(per_player, "fantacalcio_id", "left")
        .join(confirmed, "fantacalcio_id", "left")
    )

    def hits(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).cast("long")

    return joined.agg(
        F.count("*").alias("ranked"),
        hits(F.col("accepted") == 1).alias("mapped"),
        hits(F.col("decided") == 1).alias("decided"),
        hits((F.col("decided") == 0) & (F.col("pending") == 1)).alias("pending_only"),
        hits(F.col("confirmed") == 1).alias("squad_confirmed"),
    )


def freshness(df: DataFrame, label: str, updated_at: str) -> DataFrame:
    """Newest update, rows, and rows of the newest day; days combine before the final step."""
    per_day = df.groupBy(F.to_date(updated_at).alias("day")).agg(
        F.max(updated_at).alias("updated"), F.count("*").alias("n")
    )
    return per_day.agg(
        F.max("updated").alias("updated"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("records"),
        F.coalesce(F.max_by("n", "day"), F.lit(0)).cast("long").alias("newest_day_records"),
    ).select(F.lit(label).alias("source"), "updated", "records", "newest_day_records")


def flagged_ranking(
    ranking: DataFrame, alerts: DataFrame, transfers: DataFrame, diff: DataFrame
) -> DataFrame:
    """The ranking with its alert, transfer and newcomer flags."""
    flagged = flag(ranking, alerts, "fantacalcio_id", "has_availability_alert")
    flagged = flag(flagged, transfers, "fantacalcio_id", "is_recent_transfer")
    added = diff.filter(F.col("change_type") == ADDED)
    return flag(flagged, added, "fantacalcio_id", "is_new")
