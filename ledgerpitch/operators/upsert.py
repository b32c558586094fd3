"""Keyed changes to datasets that have no keys of their own."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpitch.operators.latest import first_rows
from ledgerpitch.session import durable, max_broadcast_rows

#: Keys that the hash table of one task may hold before they are dealt over more partitions.
KEYS_PER_TASK = 1_000_000


def last_per_key(rows: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """The row with the highest sequence per key."""
    return first_rows(rows, keys, [F.col(name).desc_nulls_last() for name in sequence])


def upsert(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    sequence: Sequence[str],
    keep_newest: bool = False,
) -> DataFrame:
    """New rows replace old ones with their key; the last new row of a key wins.

    With ``keep_newest`` a stored row of a higher sequence stays, so deliveries may arrive in any
    order.

    Only the batch is ranked. The stored rows are filtered by an anti join, which Spark turns into
    a broadcast when the batch is small, so a large table is not shuffled for a small batch.
    """
    batch = last_per_key(new, keys, sequence)
    touched = batch.select(*keys)
    kept = old.join(touched, list(keys), "left_anti")
    if keep_newest:
        stored = old.join(touched, list(keys), "left_semi")
        batch = last_per_key(stored.unionByName(batch), keys, sequence)
    return kept.unionByName(batch)


def insert_ignore(
    old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Existing keys stay; of several new rows with a key the first in ``order`` is added."""
    fresh = first_rows(new.join(old.select(*keys), list(keys), "left_anti"), keys, order)
    return old.unionByName(fresh)


def hashed_keys(rows: DataFrame, key: str) -> DataFrame:
    """The distinct keys of the rows, as the right side of a semi or anti join.

    The left side passes by a hash table of the keys instead of being sorted in its tasks. Up to the
    session's limit the keys are broadcast. More are dealt with the left side, over more partitions
    than the session's where these would hold more than ``KEYS_PER_TASK`` keys each, because a hash
    table is not spilled. The rows are counted first, which runs a job.
    """
    spark, keys = rows.sparkSession, rows.select(key)
    n = keys.count()
    if n <= max_broadcast_rows(spark):
        return F.broadcast(keys.distinct())
    partitions = -(-n // KEYS_PER_TASK)
    if partitions > int(spark.conf.get("spark.sql.shuffle.partitions")):
        keys = keys.repartition(partitions, key)
    return keys.distinct().hint("shuffle_hash")


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Drop every child of the given parents and add the new children."""
    return old.join(hashed_keys(parents, key), key, "left_anti").unionByName(new)


def without(old: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(removed.select(*keys).distinct(), list(keys), "left_anti")


def work_plan(
    ids: DataFrame, key: str, units: Sequence[int], unit: str, done: DataFrame
) -> DataFrame:
    """Every id with every unit that is not done yet."""
    planned = ids.select(key).distinct().select(
        key, F.explode(F.array(*[F.lit(value) for value in units])).alias(unit)
    )
    return planned.join(done.select(key, unit).distinct(), [key, unit], "left_anti")


def within_budget(plan: DataFrame, order: Sequence[str], budget: int | None) -> DataFrame:
    """The first units of work in order; the rest waits for the next run."""
    if budget is None:
        return plan
    return plan.orderBy(*order).limit(max(0, budget))


def fixture_plan(
    fixtures: DataFrame,
    ledger: DataFrame,
    *,
    finished: Sequence[str] | None = ("FT", "AET", "PEN"),
    teams: DataFrame | None = None,
    refresh: bool = False,
) -> DataFrame:
    """Fixtures still to load: finished, of the wanted teams, not complete in the ledger."""
    wanted = fixtures
    if finished is not None:
        wanted = wanted.filter(F.col("status_short").isin(*finished))
    if teams is not None:
        scope = teams.select(F.col("team_id")).distinct()
        home = scope.select(F.col("team_id").alias("home_team_id"), F.lit(True).alias("_home"))
        away = scope.select(F.col("team_id").alias("away_team_id"), F.lit(True).alias("_away"))
        wanted = (
            wanted.join(home, "home_team_id", "left")
            .join(away, "away_team_id", "left")
            .filter(F.col("_home").isNotNull() | F.col("_away").isNotNull())
            .select(*fixtures.columns)
        )
    if refresh:
        return wanted
    complete = ledger.filter(F.col("status") == "complete").select("fixture_id")
    return wanted.join(complete, "fixture_id", "left_anti")


def ingest_summary(planned: DataFrame, done: DataFrame, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: units planned, already complete, failed and still open."""
    flagged = (
        planned.select(*keys)
        .join(done.select(*keys).distinct().withColumn("_done", F.lit(1)), list(keys), "left")
        .join(failed.select(*keys).distinct().withColumn("_failed", F.lit(1)), list(keys), "left")
    )
    return flagged.agg(
        F.count("*").alias("planned"),
        F.count("_done").alias("already_complete"),
        F.count_if(F.col("_done").isNull() & F.col("_failed").isNotNull()).alias("failed"),
        F.count_if(F.col("_done").isNull() & F.col("_failed").isNull()).alias("deferred"),
    )


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replace exactly the partitions that occur in ``df``.

    Rebalancing lets AQE split a large partition over several files and merge small ones.
    """
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


#: Partitions a batch may touch and still prune the scan by a list of values.
LISTED_PARTITIONS = 1000


def _touched_rows(stored: DataFrame, new: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Stored rows of the partitions that have new rows.

    Up to ``LISTED_PARTITIONS`` the values become a filter, so the scan opens these partitions only;
    a batch that touches more reads the table once and joins.
    """
    touched = new.select(*partitions).distinct()
    values = touched.limit(LISTED_PARTITIONS + 1).collect()
    if len(values) > LISTED_PARTITIONS:
        return stored.join(touched, list(partitions), "left_semi")
    any_of = F.lit(False)
    if len(partitions) == 1:
        any_of = F.col(partitions[0]).isin([row[0] for row in values])
    else:
        for row in values:
            same = F.lit(True)
            for name in partitions:
                same = same & (F.col(name) == F.lit(row[name]))
            any_of = any_of | same
    return stored.filter(any_of)


def listed_partitions(stored: DataFrame, partition: str) -> list[str]:
    """Values of a partition column from the paths of the files; no file is opened.

    The paths come as URIs of folder names, so two kinds of escapes are undone.
    """
    marker = re.compile(rf"/{re.escape(partition)}=([^/]+)/")
    return sorted({unquote(unquote(found[1])) for name in stored.inputFiles() if (found := marker.search(name))})


def upsert_path(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys: Sequence[str],
    sequence: Sequence[str],
    partitions: Sequence[str],
    keep_newest: bool = False,
) -> None:
    """Keyed upsert of a partitioned dataset; only partitions with new rows are rewritten."""
    if not set(partitions) <= set(keys):
        raise ValueError("partition columns must belong to the key")
    old = _touched_rows(spark.read.parquet(path), new, partitions)
    # The old files are read completely before their partitions are replaced.
    merged = durable(upsert(old.select(*new.columns), new, keys, sequence, keep_newest))
    write_partitions(merged, path, partitions)


def insert_new_partitions(
    spark: SparkSession, path: str, new: DataFrame, partition: str
) -> DataFrame:
    """Write only partitions that the dataset does not hold yet; returns the written rows."""
    known = [(value,) for value in listed_partitions(spark.read.parquet(path), partition)]
    held = spark.createDataFrame(known, "_known string")
    fresh = durable(
        new.join(held, F.col(partition).cast("string") == F.col("_known"), "left_anti")
    )
    write_partitions(fresh, path, [partition])
    return fresh


def _marks(root: str) -> str:
    return f"{root.rstrip('/')}-published"


def publish_version(df: DataFrame, root: str, version: str) -> str:
    """Full refresh: a mart is written as a new version and old readers keep theirs.

    The version's mark is written after its files are committed, and readers go by the marks, so
    a version is seen whole or not at all.
    """
    target = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    mark = df.sparkSession.createDataFrame([(version,)], "version string")
    mark.coalesce(1).write.mode("append").parquet(_marks(root))
    return target


def newest_version(spark: SparkSession, root: str) -> DataFrame:
    """The newest marked version; files of versions without a mark are not looked at."""
    newest = spark.read.parquet(_marks(root)).agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/version={newest}")


#: States of a unit of ingestion (fixed values).
LEDGER_STATES = ("in_progress", "paused", "incomplete", "complete")


def record_states(
    ledger: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: Sequence[str]
) -> DataFrame:
    """The ledger with the newest state of every unit; ``changes`` has the ledger's columns.

    A change that is older than what the ledger holds does not count, so changes may come late or
    twice. A state outside ``LEDGER_STATES`` raises.
    """
    unknown = changes.filter(F.col("status").isNull() | ~F.col("status").isin(*LEDGER_STATES))
    if unknown.limit(1).count():
        raise ValueError(f"the status of a unit is one of {LEDGER_STATES}")
    return upsert(ledger, changes.select(*ledger.columns), keys, sequence, keep_newest=True)
