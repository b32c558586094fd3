"""Exact integer apportionment within groups, with and without caps, and player prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpitch.config import ROLES, League
from ledgerpitch.plans.blocks import attach, positions, running_totals
from ledgerpitch.session import durable

# Upper percentile of each price tier; rosterable players below are D, others E.
TIERS = {"S": 0.10, "A": 0.30, "B": 0.60, "C": 0.85}
SMALLEST_WEIGHT = 0.01
#: What the largest weight of a group is scaled to.
SCALE = 1 << 52


def _scaled(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Add the group's size, the weight as an integer share of the group's largest weight, and
    the sum of these integers.

    Shares and sum use the same integers, so nothing is lost between them; integer sums do not
    depend on the order of the rows. The largest weight of a group becomes 2^52, which keeps the
    weights as exact as doubles are. Missing, negative and undefined weights count as zero.
    """
    clean = F.when(
        F.col(weight).isNotNull() & ~F.isnan(F.col(weight).cast("double")) & (F.col(weight) > 0),
        F.col(weight).cast("double"),
    ).otherwise(F.lit(0.0))
    weighted = df.withColumn("_weight", clean)
    sizes = weighted.groupBy(*keys).agg(F.count("*").alias("_members"), F.max("_weight").alias("_top"))
    whole = F.when(F.col("_top") > 0, F.round(F.col("_weight") / F.col("_top") * F.lit(float(SCALE))))
    scaled = attach(weighted, sizes, keys).withColumn(
        "_whole", F.coalesce(whole.cast("decimal(16,0)"), F.lit(1).cast("decimal(16,0)"))
    )
    sums = scaled.groupBy(*keys).agg(F.sum("_whole").cast("decimal(26,0)").alias("_sum"))
    return attach(scaled, sums, keys).drop("_weight", "_top")


def largest_remainder(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    weight: str,
    total: str,
    name: str = "units",
) -> DataFrame:
    """Split the group's integer ``total`` by weight; leftovers go to the largest fractions.

    Equal fractions are served in ``order``. A group without positive weight is split evenly.
    ``total`` is a column that is the same for all rows of a group, below 10^12. The units of every
    group add up to its total, for weights of any size; a group for which they do not raises.
    """
    given = durable(_split(df, keys, order, weight, total, name))
    _check_totals(given, keys, name, total)
    return given


def _check_totals(given: DataFrame, keys: Sequence[str], name: str, total: str) -> None:
    wrong = given.groupBy(*keys).agg(F.sum(name).alias("_given"), F.first(total).alias("_total"))
    if wrong.filter(F.col("_given") != F.col("_total")).limit(1).count():
        raise ValueError("the units of a group do not add up to its total")


def _split(df: DataFrame, keys: Sequence[str], order: str, weight: str, total: str, name: str) -> DataFrame:
    """The rows with their units, of which only the shares before rounding are written."""
    whole_total = F.col(total).cast("decimal(12,0)")
    shared = _scaled(df, keys, weight).withColumn("_product", whole_total * F.col("_whole"))
    # Integer division and remainder are exact; fractions are compared by the remainder alone.
    shared = shared.withColumn("_floor", F.expr("_product div _sum")).withColumn(
        "_fraction", F.col("_product") - F.col("_floor").cast("decimal(13,0)") * F.col("_sum")
    )
    shared = durable(shared)
    missing = shared.groupBy(*keys).agg(
        (F.first(total) - F.sum("_floor")).cast("long").alias("_missing")
    )
    placed = positions(shared, keys, [F.col("_fraction").desc(), F.col(order).asc()], "_place")
    return attach(placed, missing, keys).select(
        *df.columns,
        (F.col("_floor") + F.when(F.col("_place") <= F.col("_missing"), 1).otherwise(0))
        .cast("long")
        .alias(name),
    )


def capped_allocation(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    weight: str,
    capacity: str,
    total: str,
    name: str = "units",
) -> DataFrame:
    """Largest remainder under a cap per row, repeated on the open rows until all is placed.

    Every round serves all groups at once and writes what its rows take, so a round neither gathers
    a group nor grows the lineage. Rows at their cap leave the rounds. Each round rounds to whole
    units, and later rounds start from these, so no closed form gives the same units.
    """
    checked = df.groupBy(*keys).agg(
        F.sum(capacity).alias("_room"), F.first(total).alias("_need")
    )
    short = checked.filter(F.col("_room") < F.col("_need")).limit(1).count()
    if short:
        raise ValueError("the caps of a group hold less than its total")
    state = durable(
        df.select(
            *keys,
            order,
            F.col(weight).alias("_w"),
            F.col(capacity).cast("long").alias("_cap"),
            F.lit(0).cast("long").alias("_got"),
            F.col(total).cast("long").alias("_left"),
        )
    )
    finished: list[DataFrame] = []
    while True:
        open_rows = state.filter((F.col("_got") < F.col("_cap")) & (F.col("_left") > 0))
        finished.append(state.filter((F.col("_got") >= F.col("_cap")) | (F.col("_left") <= 0)))
        if open_rows.isEmpty():
            break
        proposed = _split(open_rows, keys, order, "_w", "_left", "_offer")
        taken = proposed.withColumn(
            "_taken", F.least(F.col("_offer"), F.col("_cap") - F.col("_got"))
        )
        taken = durable(taken)
        placed = taken.groupBy(*keys).agg(F.sum("_taken").alias("_placed"))
        state = attach(taken, placed, keys).select(
            *keys,
            order,
            "_w",
            "_cap",
            (F.col("_got") + F.col("_taken")).alias("_got"),
            (F.col("_left") - F.col("_placed")).alias("_left"),
        )
    union = finished[0]
    for part in finished[1:]:
        union = union.unionByName(part)
    given = durable(attach(df, union.select(*keys, order, F.col("_got").alias(name)), [*keys, order]))
    _check_totals(given, keys, name, total)
    return given


def tiers(
    df: DataFrame, keys: Sequence[str], score: str, order: str, required: Column
) -> DataFrame:
    """Rank by score, tier by rank percentile, and the score of the last required row."""
    ranked = durable(positions(df, keys, [F.col(score).desc(), F.col(order).asc()], "rank"))
    inside = F.col("rank") <= required
    percentile = F.col("rank") / required
    tier = F.lit("D")
    for label, limit in reversed(TIERS.items()):
        tier = F.when(percentile <= limit, label).otherwise(tier)
    replacement = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == required, F.col(score))).alias("replacement")
    )
    return attach(
        ranked.withColumn("rosterable", inside).withColumn(
            "tier", F.when(inside, tier).otherwise("E")
        ),
        replacement,
        keys,
    )


def role_budgets(league: League) -> dict[str, int]:
    """Credits above one per slot, split over the four roles by share."""
    extra = league.total_budget - league.total_slots
    if extra < 0:
        raise ValueError("the budget does not cover one credit per slot")
    shares = league.each("share")
    whole = sum(shares.values())
    exact = {role: extra * share / whole for role, share in shares.items()}
    units = {role: int(exact[role]) for role in ROLES}
    by_fraction = sorted(ROLES, key=lambda role: units[role] - exact[role])
    for role in by_fraction[: extra - sum(units.values())]:
        units[role] += 1
    return units


def per_role(values: dict[str, float | int], role: Column) -> Column:
    table = F.create_map(*[F.lit(item) for pair in values.items() for item in pair])
    return F.try_element_at(table, role)


def allocate_prices(projections: DataFrame, league: League, keys: Sequence[str] = ()) -> DataFrame:
    """Tier, rosterable flag and credits per player; ``keys`` separates leagues priced together."""
    group = [*keys, "role"]
    required = per_role(league.pool(), F.col("role"))
    scarce = (
        projections.groupBy(*group)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") < required)
        .limit(1)
        .count()
    )
    roles_found = projections.select("role").distinct().count()
    if scarce or roles_found < len(ROLES):
        raise ValueError("a role has fewer players than slots")
    ranked = durable(
        tiers(projections, group, "projected_score", "fantacalcio_id", required)
    )
    pool = ranked.filter("rosterable").select(
        *group,
        "fantacalcio_id",
        F.pow(
            F.greatest(F.col("projected_score") - F.col("replacement"), F.lit(SMALLEST_WEIGHT)),
            F.lit(league.price_curve_gamma),
        ).alias("weight"),
        per_role({role: cap - 1 for role, cap in league.each("cap").items()}, F.col("role")).alias("room"),
        per_role(role_budgets(league), F.col("role")).alias("extra"),
    )
    priced = capped_allocation(pool, group, "fantacalcio_id", "weight", "room", "extra", "above_one")
    result = attach(
        ranked, priced.select(*group, "fantacalcio_id", "above_one"), [*group, "fantacalcio_id"]
    ).select(
        *projections.columns,
        F.col("rank"),
        "rosterable",
        "tier",
        (F.coalesce("above_one", F.lit(0)) + 1).cast("long").alias("suggested_credits"),
    )
    result = durable(result)
    wrong = (
        result.filter("rosterable")
        .groupBy(*keys)
        .agg(F.sum("suggested_credits").alias("spent"))
        .filter(F.col("spent") != league.total_budget)
        .limit(1)
        .count()
    )
    if wrong:
        raise ValueError("the prices do not add up to the budget")
    return result
