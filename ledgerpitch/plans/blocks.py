"""Ordered windows over groups of any size.

A window partitioned by a key sorts all rows of that key in one task. Where a key holds more rows
than ``spark.ledgerpitch.maxGroupRows`` (one million) its rows are range-partitioned on (key, order) and every
range becomes a block. Blocks are numbered in order, so a window over (key, block) plus a small
carry from the earlier blocks of the key gives the same answer as the plain window, and no task
holds more than one block. Keys below the limit keep block -1 and the plain plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerpitch.session import durable, max_broadcast_rows, max_group_rows

BLOCK = "_block"


@dataclass(frozen=True)
class Blocked:
    """Rows with a block column; ``hot`` holds only the rows of split keys."""

    rows: DataFrame
    hot: DataFrame | None
    pieces: int


def attach(
    left: DataFrame, right: DataFrame, keys: Sequence[str], rows_bound: int | None = None
) -> DataFrame:
    """Left join on keys that may be null, broadcasting the right side only below the limit."""
    renamed = right.select(
        *[F.col(key).alias(f"_r_{key}") for key in keys],
        *[F.col(name) for name in right.columns if name not in keys],
    )
    if rows_bound is not None and rows_bound <= max_broadcast_rows(left.sparkSession):
        renamed = F.broadcast(renamed)
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, "left").drop(*[f"_r_{key}" for key in keys])


def with_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    size_bound: DataFrame | None = None,
    limit: int | None = None,
) -> Blocked:
    """Number the blocks of keys above the row limit; other rows get block -1.

    ``limit`` replaces the session's limit. Integer and decimal sums are the same whether a key is
    split or not; sums of doubles are equal up to rounding, so fingerprints should round them.

    ``order`` must be a total order within a key, or ties fall in blocks at random. Rows per key
    are counted on ``size_bound`` if given, which must not have fewer rows of any key than ``df``.
    """
    spark = df.sparkSession
    limit = limit or max_group_rows(spark)
    counted = df if size_bound is None else size_bound
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    found = sizes.agg(
        F.count("*").alias("keys"), F.sum(F.ceil(F.col("_n") / limit)).alias("pieces")
    ).first()
    if not found["keys"]:
        return Blocked(df.withColumn(BLOCK, F.lit(-1)), None, 0)
    # Sampling makes range bounds uneven, so twice as many ranges as needed are asked for.
    ranges = 2 * int(found["pieces"]) + 1
    marked = sizes.select(*[F.col(key).alias(f"_h_{key}") for key in keys])
    if found["keys"] <= max_broadcast_rows(spark):
        marked = F.broadcast(marked)
    is_hot = F.lit(True)
    for key in keys:
        is_hot = is_hot & F.col(key).eqNullSafe(F.col(f"_h_{key}"))
    hot = durable(
        df.join(marked, is_hot, "left_semi")
        .repartitionByRange(ranges, *[F.col(key).asc_nulls_first() for key in keys], *order)
        .withColumn(BLOCK, F.spark_partition_id())
    )
    cold = df.join(marked, is_hot, "left_anti").withColumn(BLOCK, F.lit(-1))
    return Blocked(cold.unionByName(hot), hot, ranges + int(found["keys"]))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    limit: int | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Add one inclusive running sum per entry of ``totals`` along ``order`` within ``keys``.

    With ``keep_block`` the rows keep their block, -1 where their key is whole.
    """
    blocked = with_blocks(df, keys, order, limit=limit)
    local = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = blocked.rows.select(
        "*", *[F.sum(value).over(local).alias(name) for name, value in totals.items()]
    )
    if blocked.hot is None:
        return rows if keep_block else rows.drop(BLOCK)
    earlier = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        blocked.hot.groupBy(*keys, BLOCK)
        .agg(*[F.sum(value).alias(f"_b_{name}") for name, value in totals.items()])
        .select(
            *keys,
            BLOCK,
            *[F.sum(f"_b_{name}").over(earlier).alias(f"_c_{name}") for name in totals],
        )
    )
    joined = attach(rows, carried, [*keys, BLOCK], blocked.pieces)
    kept = [name for name in rows.columns if name not in totals and (keep_block or name != BLOCK)]
    return joined.select(
        *kept,
        *[
            (F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))).alias(name)
            for name in totals
        ],
    )


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "position",
    limit: int | None = None,
) -> DataFrame:
    """1-based place of every row within its group; the total order makes it unique."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")}, limit)


def value_counts(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Rows per distinct non-null value of a group; combines before the shuffle."""
    return (
        df.select(*keys, value.alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count("*").alias("n"))
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: Column, name: str = "median"
) -> DataFrame:
    """Exact interpolated median per group without gathering a group in one task."""
    counted = durable(value_counts(df, keys, value))
    placed = running_totals(
        counted, keys, [F.col("value").asc_nulls_last()], {"_upto": F.col("n")}
    )
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("_size"))
    joined = attach(placed, sizes, keys)
    low = F.floor((F.col("_size") - 1) / 2)
    high = F.ceil((F.col("_size") - 1) / 2)
    before = F.col("_upto") - F.col("n")

    def holds(place: Column) -> Column:
        return (before <= place) & (place < F.col("_upto"))

    return (
        joined.filter(holds(low) | holds(high))
        .groupBy(*keys)
        .agg(
            (
                (F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value"))))
                / 2
            ).alias(name)
        )
    )


def average_ranks(counted: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Average-tie rank (1-based) of each distinct value, from ``value`` and ``n`` columns."""
    placed = running_totals(
        counted, keys, [F.col("value").asc_nulls_last()], {"_upto": F.col("n")}
    )
    return placed.select(
        *keys,
        "value",
        "n",
        (F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2).alias(name),
    )
