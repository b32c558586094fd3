"""Season actuals per listed player and training examples with their past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerpitch.functions.text import season_start
from ledgerpitch.operators.latest import first_rows
from ledgerpitch.operators.quality import complete_loads

ACTUALS = ("minutes", "goals", "assists", "cards", "rating")


def primary_totals(usable: DataFrame) -> DataFrame:
    """Totals of the competition with most minutes per player and season.

    Totals are built per competition first, so the best competition is picked among a handful of
    rows and nothing is joined back.
    """

    def total(*names: str) -> Column:
        value = F.lit(0)
        for name in names:
            value = value + F.coalesce(name, F.lit(0))
        return F.sum(value)

    minutes = F.coalesce("minutes", F.lit(0))
    per_competition = usable.groupBy("fantacalcio_id", "season_start", "league_id").agg(
        F.sum(minutes).alias("minutes"),
        total("goals").alias("goals"),
        total("assists").alias("assists"),
        total("yellow_cards", "red_cards").alias("cards"),
        F.sum(F.coalesce("rating", F.lit(0.0)) * minutes).alias("weighted"),
    )
    best = first_rows(
        per_competition,
        ["fantacalcio_id", "season_start"],
        [F.col("minutes").desc(), F.col("league_id").asc()],
    )
    return best.select(
        "fantacalcio_id",
        "season_start",
        *[F.col(name).cast("double").alias(name) for name in ("minutes", "goals", "assists", "cards")],
        F.when(F.col("minutes") > 0, F.col("weighted") / F.col("minutes"))
        .otherwise(F.lit(0.0))
        .alias("rating"),
    )


def season_actuals(
    mappings: DataFrame, season_stats: DataFrame, loads: DataFrame, backfills: DataFrame
) -> DataFrame:
    """Accepted links of any season joined to completely loaded statistics."""
    links = (
        mappings.filter(F.col("status") == "accepted")
        .select("fantacalcio_id", "api_player_id")
        .distinct()
    )
    usable = complete_loads(season_stats, loads, backfills).join(links, "api_player_id")
    return primary_totals(usable)


def _actuals(actuals: DataFrame, prefix: str, season: str) -> DataFrame:
    return actuals.select(
        "fantacalcio_id",
        F.col("season_start").alias(season),
        *[F.col(name).alias(f"{prefix}_{name}") for name in ACTUALS],
    )


def realized_score(minutes: Column, rating: Column, goals: Column, assists: Column, cards: Column) -> Column:
    return F.when(minutes > 0, minutes / 90.0 * rating + 3.0 * goals + assists - 0.5 * cards)


def list_history(players: DataFrame) -> DataFrame:
    """Every listing with the values of the player's previous listing."""
    listed = players.withColumn("season_start", season_start(F.col("season")))
    order = Window.partitionBy("fantacalcio_id").orderBy("season_start")
    lagged = {
        "prev_season_start": "season_start",
        "prev_quote_current": "quote_current",
        "prev_quote_diff": "quote_diff",
        "prev_fvm": "fvm",
        "prev_role": "classic_role",
        "prev_team": "team",
    }
    return listed.select(
        "*",
        (F.row_number().over(order) - 1).alias("seasons_seen"),
        *[F.lag(source).over(order).alias(name) for name, source in lagged.items()],
    )


def build_examples(players: DataFrame, actuals: DataFrame) -> DataFrame:
    """Listings after a player's first one, with previous values, actuals and the outcome."""
    seen = list_history(players).filter(F.col("seasons_seen") > 0)
    joined = seen.join(
        _actuals(actuals, "prev", "prev_season_start"),
        ["fantacalcio_id", "prev_season_start"],
        "left",
    ).join(_actuals(actuals, "now", "season_start"), ["fantacalcio_id", "season_start"], "left")
    return joined.select(
        *players.columns,
        "season_start",
        F.col("prev_quote_current").cast("double").alias("prev_quote_current"),
        F.col("prev_quote_diff").cast("double").alias("prev_quote_diff"),
        F.col("prev_fvm").cast("double").alias("prev_fvm"),
        F.col("seasons_seen").cast("double").alias("seasons_seen"),
        (~F.col("prev_role").eqNullSafe(F.col("classic_role"))).cast("double").alias("role_changed"),
        (~F.col("prev_team").eqNullSafe(F.col("team"))).cast("double").alias("team_changed"),
        *[F.coalesce(f"prev_{name}", F.lit(0.0)).alias(f"prev_{name}") for name in ACTUALS],
        realized_score(*[F.col(f"now_{name}") for name in ("minutes", "rating", "goals", "assists", "cards")])
        .alias("realized_score"),
    )


def target_rows(
    players: DataFrame, examples: DataFrame, actuals: DataFrame, season: str
) -> DataFrame:
    """Active players of the season; newcomers get zeros and last season's actuals."""
    start = int(season.split("/")[0])
    current = examples.filter((F.col("season") == season) & (F.col("status") == "active"))
    active = players.filter((F.col("season") == season) & (F.col("status") == "active"))
    newcomers = active.join(current, "fantacalcio_id", "left_anti").withColumn(
        "season_start", F.lit(start)
    )
    before = _actuals(actuals, "prev", "prev_season_start").filter(
        F.col("prev_season_start") == start - 1
    )
    zeros = ("prev_quote_current", "prev_quote_diff", "prev_fvm", "seasons_seen", "role_changed", "team_changed")
    filled = newcomers.join(before.drop("prev_season_start"), "fantacalcio_id", "left").select(
        *players.columns,
        "season_start",
        *[F.lit(0.0).alias(name) for name in zeros],
        *[F.coalesce(f"prev_{name}", F.lit(0.0)).alias(f"prev_{name}") for name in ACTUALS],
        F.lit(None).cast("double").alias("realized_score"),
    )
    return current.unionByName(filled)
