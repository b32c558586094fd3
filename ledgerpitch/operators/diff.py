"""Differences between two versions of a ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpitch.operators.latest import first_rows

# Labels of the published diff.
ADDED = "nuovo"
REMOVED = "rimosso"
UPDATED = "aggiornato"


def build_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Added, removed and changed players between two builds; null-safe on every column."""
    shown = {"quote": "official_quote", "fvm": "official_fvm", "credits": "suggested_credits"}
    described = ("name", "team", "role")

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "fantacalcio_id",
            F.lit(True).alias(f"{prefix}_here"),
            *[F.col(name).alias(f"{prefix}_{name}") for name in described],
            *[F.col(source).alias(f"{prefix}_{name}") for name, source in shown.items()],
        )

    joined = side(current, "new").join(side(previous, "old"), "fantacalcio_id", "full")
    changed = F.lit(False)
    for name in ("team", "role", *shown):
        changed = changed | ~F.col(f"new_{name}").eqNullSafe(F.col(f"old_{name}"))
    return joined.filter(changed | F.col("old_here").isNull() | F.col("new_here").isNull()).select(
        "fantacalcio_id",
        *[F.coalesce(f"new_{name}", f"old_{name}").alias(name) for name in described],
        F.when(F.col("old_here").isNull(), ADDED)
        .when(F.col("new_here").isNull(), REMOVED)
        .otherwise(UPDATED)
        .alias("change_type"),
        *[F.col(f"{age}_{name}") for name in shown for age in ("old", "new")],
    )


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change_type").agg(F.count("*").alias("players"))


def movers(diff: DataFrame, top: int = 6) -> DataFrame:
    """The dearest newcomers and the largest rises and falls in credits."""
    delta = F.coalesce(F.col("new_credits") - F.col("old_credits"), F.lit(0))
    updated = F.col("change_type") == UPDATED
    grouped = diff.withColumn("credit_delta", delta).withColumn(
        "movement",
        F.when(F.col("change_type") == ADDED, "new")
        .when(updated & (F.col("credit_delta") > 0), "rising")
        .when(updated & (F.col("credit_delta") < 0), "falling"),
    )
    size = F.when(F.col("movement") == "new", F.coalesce("new_credits", F.lit(0))).otherwise(
        F.abs("credit_delta")
    )
    return first_rows(
        grouped.filter(F.col("movement").isNotNull()),
        ["movement"],
        [size.desc(), F.col("role"), F.col("name"), F.col("fantacalcio_id")],
        top,
        place="place",
    )


def flag(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """Add a boolean telling whether the key occurs in ``ids``."""
    present = ids.select(key).distinct().withColumn("_present", F.lit(True))
    return df.join(present, key, "left").withColumn(name, F.col("_present").isNotNull()).drop("_present")


def leaders(ranking: DataFrame, top: int = 3) -> DataFrame:
    return first_rows(
        ranking.filter("rosterable"),
        ["role"],
        [
            F.col("suggested_credits").desc(),
            F.col("projected_score").desc(),
            F.col("name").asc(),
            F.col("fantacalcio_id").asc(),
        ],
        top,
        place="place",
    )


def watchlist(
    ranking: DataFrame,
    top: int = 2,
    max_credits: int = 40,
    min_share: float = 0.60,
    min_reliability: int = 55,
) -> DataFrame:
    """Affordable, reliable starters without an alert, two per role."""
    eligible = ranking.filter(
        F.col("rosterable")
        & (F.col("suggested_credits") <= max_credits)
        & (F.col("expected_start_share") >= min_share)
        & (F.col("reliability") >= min_reliability)
        & ~F.col("has_availability_alert")
    )
    order: Sequence = [
        F.col("expected_start_share").desc(),
        F.col("reliability").desc(),
        F.col("projected_score").desc(),
        F.col("suggested_credits").desc(),
        F.col("name").asc(),
        F.col("fantacalcio_id").asc(),
    ]
    return first_rows(eligible, ["role"], order, top, place="place").orderBy(
        F.col("expected_start_share").desc(), F.col("reliability").desc(), F.col("fantacalcio_id")
    )
